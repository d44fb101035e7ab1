"""Cross-tokenizer alignment with pair counts by external spill counting.

Tasks encode texts with both tokenizers, lay the byte ends of both on one line and read off groups and links. The links of
up to 4,096 texts are one spill: records (B id, A id, document) in this order, radix-partitioned by B id into runs, each
run sorted and compressed. Its heads (pairs with their counts) and its tails (who holds them) are separate, so counting
never moves a document. Runs of one partition are merged by a heap over their blocks, in levels of bounded width; since
B comes first, all pairs of a B id pass in a row and its highest count is known when they have passed. Then each run is
read once more beside the counts of its partition, and what its records contribute streams back to its documents.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import written

# Fixed value: how byte-level tokenizers of this kind part a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"
DOC_BITS = 12
BLOCK = 16_384


@dataclass
class Side:
    """A tokenizer: ids of a text as it stands in the comparison (with a space before it), and the bytes of each id."""

    ids: Callable[[str], np.ndarray]
    bytes_: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(b) for b in self.bytes_], np.int64)
        self.digits = np.zeros((len(self.bytes_), len(str(len(self.bytes_))) + 1), np.uint8)
        for i in range(len(self.bytes_)):
            own = str(i).encode()
            self.digits[i, : len(own)] = np.frombuffer(own, np.uint8)
        self.widths = (self.digits > 0).sum(1) + 1

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_.__getitem__, ids.tolist()))


def byte_alphabet() -> dict[str, int]:
    """Sign to byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str) -> Side:
    """A byte-level BPE file; special tokens inside texts are plain text.

    A plain byte-level model whose merges stand in the order of their ids is run by the faster of the two public libraries.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    signs, model = byte_alphabet(), told["model"]
    added = {t["id"]: t["content"].encode() for t in told.get("added_tokens") or []}
    table = [b""] * (max([*model["vocab"].values(), *added]) + 1)
    for piece, i in model["vocab"].items():
        table[i] = bytes(signs[c] for c in piece)
    for i, content in added.items():
        table[i] = table[i] or content
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"].get(a + b, -1) for a, b in merges]
    before = told.get("pre_tokenizer") or {}
    plain = told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not model.get("ignore_merges")
    if plain and order == sorted(order) and order[:1] > [255] and len({*order}) == len(order) == len(model["vocab"]) - 256:
        import tiktoken

        fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={table[i]: i for i in model["vocab"].values()}, special_tokens={})
        return Side(lambda text: np.array(fast.encode_ordinary(" " + text), np.int64), table)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return Side(lambda text: np.array(slow.encode(" " + text, add_special_tokens=False).ids, np.int64), table)


def pieces(path: str) -> Side:
    """A SentencePiece model, which sets the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes((int(p[3:5], 16),)) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
    return Side(lambda text: np.array(model.encode(text, num_threads=1), np.int64), table)


@dataclass
class Lines:
    """Aligned texts, one after the other: per text its counts and groups, and per link the text and both ids."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    text: np.ndarray
    a: np.ndarray
    b: np.ndarray


def lines(found_a: list[np.ndarray], found_b: list[np.ndarray], a: Side, b: Side) -> Lines:
    """Lays both sides of texts, whose bytes are equal, on one line.

    Two tokens overlap in exactly one stretch between neighbouring ends of either side, so stretches are links; ends of
    both sides close a group. Groups are written as A ids, B ids, parted by ``|``, and by ``;`` among each other.
    """
    n, ids_a, ids_b = len(found_a), np.concatenate(found_a), np.concatenate(found_b)
    n_a, n_b = (np.array([len(x) for x in found]) for found in (found_a, found_b))
    ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    flags = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    flags[ends_a] = 1
    flags[ends_b] |= 2
    marks = flags[flags > 0]
    is_a, is_b = marks & 1, marks >> 1
    at_a, at_b = (np.cumsum(x, dtype=np.int64) - x for x in (is_a, is_b))
    both = is_a & is_b
    group = np.cumsum(both, dtype=np.int64) - both
    text = np.repeat(np.arange(n), n_a)[at_a]
    # Groups of the tokens, and each token's place when all are written group by group, A before B.
    group_a, group_b = group[is_a == 1], group[is_b == 1]
    many = int(group[-1]) + 1
    in_a, in_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
    place_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
    wide = max(a.digits.shape[1], b.digits.shape[1])
    signs, widths = np.zeros((len(ids_a) + len(ids_b), wide), np.uint8), np.empty(len(ids_a) + len(ids_b), np.int64)
    for side, ids, place, own, end in ((a, ids_a, place_a, group_a, ord("|")), (b, ids_b, place_b, group_b, ord(";"))):
        last = np.append(own[1:] != own[:-1], True)
        written_ = side.digits[ids]
        written_[np.arange(len(ids)), side.widths[ids] - 1] = np.where(last, end, ord(","))
        signs[place, : written_.shape[1]] = written_
        widths[place] = side.widths[ids]
    stops = np.cumsum(widths)[np.cumsum(n_a + n_b) - 1].tolist()
    spelled = signs[signs > 0].tobytes()
    texts = [spelled[lo : hi - 1] for lo, hi in zip([0, *stops], stops)]
    return Lines(n_a, n_b, np.bincount(text[both == 1], minlength=n), np.bincount(text, minlength=n), texts, text, ids_a[at_a], ids_b[at_b])


# --- runs


def packed(*arrays: np.ndarray) -> bytes:
    """Blocks of equally long whole-number arrays, the first ascending and stored as steps, in one zstd frame."""
    out = io.BytesIO()
    with zstandard.ZstdCompressor(level=3).stream_writer(out, closefd=False) as w:
        for start in range(0, len(arrays[0]), BLOCK):
            part = [x[start : start + BLOCK] for x in arrays]
            w.write(np.int64(len(part[0])).tobytes())
            w.write(np.diff(part[0], prepend=np.int64(0)).astype(np.int64).tobytes())
            for x in part[1:]:
                w.write(x.astype(np.int64).tobytes())
    return out.getvalue()


def blocks(data: bytes, n: int) -> Iterator[list[np.ndarray]]:
    """The blocks of ``n`` arrays, one after the other."""
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as r:
        while head := r.read(8):
            size = 8 * int(np.frombuffer(head, np.int64)[0])
            part = [np.frombuffer(r.read(size), np.int64) for _ in range(n)]
            yield [np.cumsum(part[0]), *part[1:]]


def whole(data: bytes, n: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*blocks(data, n))]


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and their counts over all runs, ascending: a k-way merge by a heap of the last keys of the runs' present blocks.

    When the smallest of these is taken, every key up to it stands in the present blocks.
    """
    sources = [blocks(data, 2) for data in runs]
    held: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def refill(i: int) -> None:
        block = next(sources[i], None)
        if block is None:
            held.pop(i, None)
        else:
            held[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        refill(i)
    while heap:
        last, i = heapq.heappop(heap)
        ready = []
        for j, (keys, counts) in held.items():
            cut = int(np.searchsorted(keys, last, "right"))
            if cut:
                ready.append((keys[:cut], counts[:cut]))
                held[j] = [keys[cut:], counts[cut:]]
        if ready:  # nothing is left of a block whose last key another one shares
            keys, at = np.unique(np.concatenate([k for k, _ in ready]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([c for _, c in ready]))
            yield keys, total
        refill(i)


class Spill:
    """Records of up to 4,096 texts, cut into runs by the B id."""

    def __init__(self, radix: int, bits: int) -> None:
        self.radix, self.bits = radix, bits
        self.records: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.docs = self.held = 0

    def add(self, found: Lines) -> None:
        keys = ((found.b << self.bits | found.a) << DOC_BITS) | (found.text + self.docs)
        records, times = np.unique(keys, return_counts=True)
        self.records.append(records)
        self.times.append(times)
        self.docs += len(found.n_a)
        self.held += len(records)

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Partition, heads (pair, count, number of records) and tails (document, times) of each run."""
        records = np.concatenate(self.records)
        order = np.argsort(records, kind="stable")
        records, times = records[order], np.concatenate(self.times)[order]
        part = (records >> (DOC_BITS + self.bits)) % self.radix
        for p in range(self.radix):
            own = part == p
            if own.any():
                some, often = records[own], times[own]
                keys, first, n = np.unique(some >> DOC_BITS, return_index=True, return_counts=True)
                docs = some & ((1 << DOC_BITS) - 1)
                # Tails carry their pair's number, so that blocks need no other index.
                tails = packed((np.repeat(np.arange(len(keys)), n) << DOC_BITS) | docs, often)
                yield p, packed(keys, np.add.reduceat(often, first)), tails


# --- Spark


def spilled(rows: DataFrame, path_a: str, path_b: str, radix: int, digest: bool, chars: int, records: int) -> DataFrame:
    """Per text a row with its counts, groups and place in a spill; per run a row with its partition, heads and tails."""
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, spill long, place int, part int, heads binary, tails binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        bits = max(1, (len(a.bytes_) - 1).bit_length())
        if bits + (len(b.bytes_) - 1).bit_length() + DOC_BITS > 63:
            raise ValueError("the two vocabularies are too large for one key")
        first, number = TaskContext.get().partitionId() << 32, 0
        spill, own = Spill(radix, bits), None

        def told(columns: dict[str, list]) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            types = {"key": own, "groups": pa.string(), "place": pa.int32(), "part": pa.int32(), "heads": pa.binary(), "tails": pa.binary()}
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), types.get(c, pa.int64())) for c in names], names=names)

        def aligned(keys: list, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            found_a, found_b, at = [], [], []
            for i, text in enumerate(texts):
                if text:
                    ids_a, ids_b = a.ids(text), b.ids(text)
                    if a.joined(ids_a) == b.joined(ids_b) == b" " + text.encode("utf-8", "surrogatepass"):
                        found_a.append(ids_a), found_b.append(ids_b), at.append(i)
            zeros = [0] * len(texts)
            out = {"key": keys, "n_a": zeros, "n_b": [*zeros], "n_groups": [*zeros], "n_links": [*zeros], "groups": [""] * len(texts), "spill": [None] * len(texts), "place": [None] * len(texts)}
            if at:
                found = lines(found_a, found_b, a, b)
                for k, i in enumerate(at):
                    out["groups"][i] = hashlib.sha256(found.groups[k]).hexdigest() if digest else found.groups[k].decode()
                    out["spill"][i], out["place"][i] = first + number, spill.docs + k
                for c in ("n_a", "n_b", "n_groups", "n_links"):
                    out[c] = [*zeros]
                    for i, v in zip(at, getattr(found, c).tolist()):
                        out[c][i] = v
                spill.add(found)
            yield told(out)

        def closed() -> Iterator[pa.RecordBatch]:
            if spill.docs:
                for p, heads, tails in spill.runs():
                    yield told({"spill": [first + number], "part": [p], "heads": [heads], "tails": [tails]})

        for batch in batches:
            own = batch.schema.field(0).type
            keys, sizes = batch.column(0).to_pylist(), [len(t.as_py() or "") for t in batch.column(1)]
            start = 0
            while start < len(keys):
                # Up to ``chars`` signs at once, one text at least.
                stop = start + 1
                held = sizes[start]
                while stop < len(keys) and stop - start < 512 and held + sizes[stop] <= chars:
                    held += sizes[stop]
                    stop += 1
                if spill.docs + stop - start > 1 << DOC_BITS or spill.held > records:
                    yield from closed()
                    spill, number = Spill(radix, bits), number + 1
                yield from aligned(keys[start:stop], batch.column(1).slice(start, stop - start).to_pylist())
                start = stop
        yield from closed()

    return rows.mapInArrow(run, schema)


def counted(runs: DataFrame, id_bits: int, fan: int) -> DataFrame:
    """``part, heads``: one run per partition with all its pairs (pair, count, 1 where the count is its B id's highest).

    Runs are merged ``fan`` at a time, level by level, so that a task never holds more than this many.
    """
    level = runs.select("part", F.col("spill").alias("run"), "heads")
    while True:
        widest = level.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
        lots = -(-widest // fan)
        last = lots <= 1

        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            keys, counts = (np.concatenate(x) for x in zip(*merged(list(rows["heads"]))))
            best = [counts]
            if last:
                starts = np.flatnonzero(np.diff(keys >> id_bits, prepend=-1))
                top = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(keys))))
                best += [(counts == top).astype(np.int64)]
            return pd.DataFrame({"part": [key[0]], "run": [key[1]], "heads": [packed(keys, *best)]})

        lot = F.pmod(F.xxhash64("run", F.lit(lots)), F.lit(max(1, lots)))
        level = written(level.withColumn("lot", lot).groupBy("part", "lot").applyInPandas(merge, "part int, run long, heads binary"), "heads")
        if last:
            return level.select("part", "heads")


def contributions(runs: DataFrame, counts: DataFrame, most_bytes: int) -> DataFrame:
    """``spill, places, sums, bests``: per run, what its records give to each document of its spill."""
    sizes = runs.groupBy("part").agg(F.ceil(F.sum(F.length("heads") + F.length("tails")) / most_bytes).cast("long").alias("lots"))
    left = runs.select("part", "spill", "heads", "tails").join(sizes, "part").withColumn("lot", F.pmod(F.xxhash64("spill"), "lots"))
    right = counts.join(sizes, "part").select("part", F.col("heads").alias("counts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))

    def give(key: tuple, some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some):
            pairs, counts_, best = whole(known["counts"].iloc[0], 3)
            for spill, heads, tails in zip(some["spill"], some["heads"], some["tails"]):
                at = np.searchsorted(pairs, whole(heads, 2)[0])
                sums, bests = np.zeros(1 << DOC_BITS, np.int64), np.zeros(1 << DOC_BITS, np.int64)
                for record, times in blocks(tails, 2):
                    own, place = at[record >> DOC_BITS], record & ((1 << DOC_BITS) - 1)
                    np.add.at(sums, place, times * counts_[own])
                    np.add.at(bests, place, times * best[own])
                places = np.flatnonzero(sums)
                out.append((spill, places, sums[places], bests[places]))
        return pd.DataFrame(out, columns=["spill", "places", "sums", "bests"])

    grouped = left.groupBy("part", "lot").cogroup(right.groupBy("part", "lot"))
    return grouped.applyInPandas(give, "spill long, places array<long>, sums array<long>, bests array<long>")


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digest: bool = False, radix: int = 32, fan: int = 64, chars: int = 1_000_000, records: int = 2_000_000, most_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """Aligns two tokenizers over all texts; returns the texts and the pairs.

    Texts: one row per row of ``docs`` with key, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (token occurrences whose
    bytes overlap), ``n_best`` (links whose pair is the most frequent one of its B id, ties included), ``count_sum`` (over the
    links, how often their pair is linked in all texts) and ``groups`` (``a1,a2|b1;a3|b2``; its sha256 with ``digest``, which
    keeps what is stored small). Pairs: ``b_id, a_id, n, best``.

    ``path_a`` is a byte-level BPE file, whose text gets a space in front, ``path_b`` a SentencePiece model; both are read in
    the tasks. Special tokens in a text are plain text. Null and empty texts, and those that either tokenizer does not give
    back byte by byte (such as texts with a literal U+2581), have no tokens: zeros and empty groups. Null keys stay;
    repeated rows count as often as they stand; no other column is read, whatever its name; an empty table gives empty
    results. Texts are taken whole. ``chars`` and ``records`` bound what a task holds besides one text, ``fan`` the runs it
    merges, ``most_bytes`` the runs it reads beside a partition's counts, which the vocabularies bound.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    told = written(spilled(rows, path_a, path_b, radix, digest, chars, records), "spills")
    runs = told.filter("part is not null").select("spill", "part", "heads", "tails")
    bits = max(1, (len(byte_level(path_a).bytes_) - 1).bit_length())
    counts = counted(runs, bits, fan)
    given = written(contributions(runs, counts, most_bytes), "given")

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    texts = told.filter("part is null").select("key", "n_a", "n_b", "n_groups", "n_links", "groups", "spill", "place")
    kind = rows.schema["key"].dataType.simpleString()

    def total(batch: pd.DataFrame) -> pd.DataFrame:
        sums, bests = np.zeros(1 << DOC_BITS, np.int64), np.zeros(1 << DOC_BITS, np.int64)
        for places, s, b in zip(batch["places"], batch["sums"], batch["bests"]):
            sums[places] += s
            bests[places] += b
        places = np.flatnonzero(sums)
        return pd.DataFrame({"spill": batch["spill"].iloc[0], "place": places.astype(np.int32), "count_sum": sums[places], "n_best": bests[places]})

    summed = given.groupBy("spill").applyInPandas(total, "spill long, place int, count_sum long, n_best long")
    out = texts.join(summed, ["spill", "place"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("count_sum", "n_best")})

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for keys, n, best in blocks(data.as_py(), 3):
                    yield pa.RecordBatch.from_arrays([pa.array(keys >> bits), pa.array(keys & ((1 << bits) - 1)), pa.array(n), pa.array(best == 1)], names=["b_id", "a_id", "n", "best"])

    pairs = counts.select("heads").mapInArrow(spelled, "b_id long, a_id long, n long, best boolean")
    return out.select(*names).withColumnRenamed("key", key), pairs
