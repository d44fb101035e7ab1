"""Interaction graphs from logs: tables, channels, degrees, clustering, backbone, timing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators.ordering import value_ranks


def logs_to_graph(messages: DataFrame, file_events: DataFrame, turns: DataFrame) -> dict[str, DataFrame]:
    """Four linked tables from logs.

    ``messages(run, ts, sender, recipient, bytes)``, ``file_events(run, ts, agent, file, op, bytes)`` with op read or
    write, ``turns(run, turn, role, tokens)``. A read runs from file to agent, a write from agent to file.
    """
    agent = lambda c: F.concat(F.lit("agent:"), F.col(c))
    file = F.concat(F.lit("file:"), F.col("file"))
    msg = messages.select("run", "ts", agent("sender").alias("src"), agent("recipient").alias("dst"), F.lit("message").alias("channel"), "bytes")
    wrote = file_events.filter("op = 'write'").select("run", "ts", agent("agent").alias("src"), file.alias("dst"), F.lit("write").alias("channel"), "bytes")
    read = file_events.filter("op = 'read'").select("run", "ts", file.alias("src"), agent("agent").alias("dst"), F.lit("read").alias("channel"), "bytes")
    edges = msg.unionByName(wrote).unionByName(read)
    ends = edges.select("run", F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = ends.select("run", "node", F.split("node", ":")[0].alias("kind"))
    runs = edges.groupBy("run").agg(F.count(F.lit(1)).alias("n_edges"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return {"nodes": nodes, "edges": edges, "turns": turns, "runs": runs}


def channel_costs(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Edges, bytes and tokens per run and channel; a turn's tokens are shared evenly by its calls.

    ``edges(run, turn, channel, bytes)`` are counted per turn and channel first, so no turn is spread out.
    """
    per = edges.groupBy("run", "turn", "channel").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes").alias("bytes"))
    whole = per.groupBy("run", "turn").agg(F.sum("calls").alias("all_calls"))
    j = per.join(whole, ["run", "turn"]).join(turns.select("run", "turn", "tokens"), ["run", "turn"], "left")
    share = F.coalesce("tokens", F.lit(0)) * F.col("calls") / F.col("all_calls")
    return j.groupBy("run", "channel").agg(F.sum("calls").alias("edges"), F.sum("bytes").alias("bytes"), F.sum(share).alias("tokens"))


def directed_counts(messages: DataFrame, roster: DataFrame) -> DataFrame:
    """Messages per ordered pair inside each run; only configured endpoints, no messages to oneself. Counting comes first."""
    counts = messages.filter("sender <> recipient").groupBy("run", "sender", "recipient").agg(F.count(F.lit(1)).alias("n"))
    known = lambda side: roster.select(F.col("agent").alias(side))
    return counts.join(known("sender"), "sender", "left_semi").join(known("recipient"), "recipient", "left_semi").select("run", "sender", "recipient", "n")


def sustained_graph(counts: DataFrame, least: int = 2) -> DataFrame:
    """Undirected edges ``(run, a, b)`` with a < b where one direction carried at least ``least`` messages."""
    kept = counts.filter(F.col("n") >= least)
    return kept.select("run", F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b")).distinct()


def degrees(graph: DataFrame) -> DataFrame:
    return graph.select("run", F.explode(F.array("a", "b")).alias("agent")).groupBy("run", "agent").agg(F.count(F.lit(1)).alias("degree"))


def mean_degree(graph: DataFrame, roster: DataFrame, runs: DataFrame) -> DataFrame:
    """Sum of degrees over the full team size per run; silent agents and silent runs count as zero."""
    team = roster.select(F.countDistinct("agent").cast("double")).scalar()
    per = graph.groupBy("run").agg((2 * F.count(F.lit(1))).alias("d"))
    return runs.select("run").join(per, "run", "left").select("run", (F.coalesce("d", F.lit(0)) / team).alias("mean_degree"))


def transitivity(graph: DataFrame) -> DataFrame:
    """Closed over connected triples per run.

    Connected triples follow from degrees alone. For triangles every edge points to the end of higher degree, so a node
    has at most sqrt(2m) outgoing edges and a hub never pairs up all its partners.
    """
    deg = degrees(graph)
    triples = deg.groupBy("run").agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"))
    da, db = deg.select("run", F.col("agent").alias("a"), F.col("degree").alias("da")), deg.select("run", F.col("agent").alias("b"), F.col("degree").alias("db"))
    e = graph.join(da, ["run", "a"]).join(db, ["run", "b"])
    up = F.struct("da", "a") < F.struct("db", "b")
    low, high = F.when(up, F.col("a")).otherwise(F.col("b")), F.when(up, F.col("b")).otherwise(F.col("a"))
    arcs = e.select("run", low.alias("u"), high.alias("v"))
    wedges = arcs.join(arcs.select("run", "u", F.col("v").alias("w")), ["run", "u"]).filter("v < w")
    closed = wedges.join(graph.select("run", F.col("a").alias("v"), F.col("b").alias("w")), ["run", "v", "w"]).groupBy("run").agg(F.count(F.lit(1)).alias("triangles"))
    j = triples.join(closed, "run", "left")
    n3 = 3 * F.coalesce("triangles", F.lit(0))
    return j.select("run", n3.alias("closed"), F.col("triples").cast("long").alias("connected"), F.when(F.col("triples") > 0, n3 / F.col("triples")).otherwise(0.0).alias("transitivity"))


def out_degree(counts: DataFrame, roster: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """Distinct peers sent at least ``least`` messages, averaged over the whole team and over the agents that sent any."""
    team = roster.select(F.countDistinct("agent").cast("double")).scalar()
    per = counts.groupBy("run", "sender").agg(F.count_if(F.col("n") >= least).alias("peers"))
    g = per.groupBy("run").agg(F.sum("peers").alias("s"), F.avg("peers").alias("per_participant"))
    j = runs.select("run").join(g, "run", "left")
    return j.select("run", (F.coalesce("s", F.lit(0)) / team).alias("per_agent"), F.coalesce("per_participant", F.lit(0.0)).alias("per_participant"))


def disparity_backbone(edges: DataFrame, a: str, b: str, weight: str, alpha: float) -> DataFrame:
    """Edges heavier than an even spread would make them, seen from at least one end (published disparity test)."""

    def end(side: str) -> DataFrame:
        return edges.groupBy(side).agg(F.sum(weight).alias(f"_s_{side}"), F.count(F.lit(1)).alias(f"_k_{side}"))

    j = edges.join(end(a), a).join(end(b), b)
    p = lambda side: F.when(F.col(f"_k_{side}") > 1, F.pow(1 - F.col(weight) / F.col(f"_s_{side}"), F.col(f"_k_{side}") - 1)).otherwise(1.0)
    scored = j.withColumn("p", F.least(p(a), p(b)))
    return scored.filter(F.col("p") < alpha).select(a, b, weight, "p")


def concentration(df: DataFrame, key: str, n: int) -> DataFrame:
    """Share of rows held by the n biggest publishers."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    whole = counts.agg(F.sum("c").cast("double")).scalar()
    top = counts.orderBy(F.desc("c"), key).limit(n)
    return top.agg(F.count(F.lit(1)).alias("publishers"), F.sum("c").alias("rows"), (F.sum("c") / whole).alias("share"))


def few_posters(df: DataFrame, cluster: str, poster: str, share: float) -> DataFrame:
    """Clusters in which one poster wrote at least the given share."""
    per = df.groupBy(cluster, poster).agg(F.count(F.lit(1)).alias("c"))
    g = per.groupBy(cluster).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("posters"), (F.max("c") / F.sum("c")).alias("top_share"))
    return g.filter(F.col("top_share") >= share)


def handshake_curve(messages: DataFrame, parts: int | None = None) -> DataFrame:
    """First contact of every ordered pair on the run's time scaled to [0, 1], with the cumulative share of pairs.

    ``messages(run, at, sender, recipient)`` with ``at`` as whole units of time.
    """
    first = messages.groupBy("run", "sender", "recipient").agg(F.min("at").alias("first"))
    span = messages.groupBy("run").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    tau = F.when(F.col("hi") > F.col("lo"), (F.col("first") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    scaled = first.join(span, "run").select("run", "sender", "recipient", tau.alias("tau"))
    ranked = value_ranks(scaled, ["run"], "tau", parts)
    return ranked.select("run", "tau", F.col("n").alias("pairs"), (F.col("n_to") / F.col("n_all")).alias("share"))


def handshake_time(curve: DataFrame, share: float = 0.9) -> DataFrame:
    """Time by which the share of pairs has appeared, per run."""
    return curve.groupBy("run").agg(F.min(F.when(F.col("share") >= share, F.col("tau"))).alias("tau"))


def leads(events: DataFrame, run: str, at: Column, channel: str, first: str, second: str) -> DataFrame:
    """Share of runs in which one channel's mean time comes before the other's; runs lacking one drop out."""
    pick = lambda c: F.avg(F.when(F.col(channel) == c, at))
    per = events.groupBy(run).agg(pick(first).alias("a"), pick(second).alias("b")).filter("a is not null and b is not null")
    return per.agg(F.count(F.lit(1)).alias("runs"), F.avg((F.col("a") < F.col("b")).cast("double")).alias("leads"))


def access_audit(reads: DataFrame, runs: DataFrame, kinds: Mapping[str, Column]) -> DataFrame:
    """Share of runs with a read outside the workspace, per kind of path; the kinds are a short list of conditions."""
    n = runs.select(F.countDistinct("run").cast("double")).scalar()
    per = reads.groupBy("run").agg(*[F.max(c.cast("int")).alias(k) for k, c in kinds.items()])
    g = per.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("runs"), (F.col(k) / n).alias("share")) for k in kinds])
    return g.select(F.explode(rows).alias("r")).select("r.*")
