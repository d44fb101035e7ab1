"""Text, reference, LaTeX and page functions, readers and writers on small files."""

import os

import pytest
from pyspark.sql import functions as F

from attestry.functions import latex, pages, refs, text
from attestry.operators import coverage, findings
from attestry.sources import files, reports


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).head()[0]


# Sentences as they stand in the pages of the test tables, and what a converter may add to them without changing what they say.
PLAIN = ["Tides rise twice a day, 12.4 hours apart.", "A page of 31 lines lists the harbour dues (see note 7).", "Der Pegel fiel um 3 % auf 88 cm."]


def words_wrapped(sentence, left, right):
    """Every second word between two signs."""
    return " ".join(left + w + right if i % 2 else w for i, w in enumerate(sentence.split(" ")))


def same(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string")
    return [r.same for r in rows.select((text.normalize("a") == text.normalize("b")).alias("same")).collect()]


def test_emphasis_and_escapes_do_not_count(spark):
    assert all(same(spark, [(p, words_wrapped(p, m, m)) for p in PLAIN for m in ("*", "**", "***", "$", "{}")]))
    assert all(same(spark, [(p, p.replace(c, "\\" + c)) for p in PLAIN for c in ",.%()"]))


def test_blanks_of_any_kind_are_one_blank(spark):
    assert all(same(spark, [(p, f"{e}{p.replace(' ', b)}{e}") for p in PLAIN for b in ("  ", "\n", "\t", "\u00a0", " \u00a0\r\n") for e in ("", " ", "\n\n")]))


def test_unseen_operators_do_not_count(spark):
    assert all(same(spark, [(p, sign.join(p)) for p in PLAIN for sign in "\u2061\u2062\u2063\u2064\u200b"]))


def test_pictures_go_and_links_keep_their_words(spark):
    assert all(same(spark, [(p, f"![{alt}](x/{i}.png){p}![](y.svg)") for p in PLAIN for i, alt in enumerate(("", "tide gauge"))]))
    assert all(same(spark, [(p, words_wrapped(p, "[", "](https://example.org/a?b=c#d)")) for p in PLAIN]))


def test_raised_and_lowered_digits_are_digits(spark):
    digits = "0123456789"
    assert all(same(spark, [(digits, "⁰¹²³⁴⁵⁶⁷⁸⁹"), (digits, "₀₁₂₃₄₅₆₇₈₉"), ("t-1", "t−1"), ("x1", "x_(1)"), ("km2", "km^{2}"), ("Area and Lake", "Area_( and )Lake")]))


def test_what_is_said_still_counts(spark):
    changed = [(p, p.replace(x, y)) for p in PLAIN for x, y in (("1", "2"), (" ", ""), (".", ","), ("e", "E"), ("3", "")) if x in p]
    changed += [(p, p + " " + p) for p in PLAIN] + [("a_b", "ab"), ("see [the note](u)", "see u"), ("(7)", "7"), ("-1", "1"), ("#1", "1")]
    assert not any(same(spark, changed))


def reference_forms():
    """What may stand around an id, by the grammar ``[host and path | arXiv:] id [vN] [.pdf] [?...]``; the ids are free."""
    fronts = ["", "arXiv:"] + [f"{scheme}{host}arxiv.org/{path}/" for scheme in ("", "http://", "https://") for host in ("", "www.", "export.") for path in ("abs", "pdf", "html")]
    for i, front in enumerate(fronts):
        for j, pid in enumerate(("2301.00417", "1907.1234", "cond-mat/9912345", "math.CO/0607042")):
            for version in (None, 1, 14):
                tail = ("", ".pdf", "?a=b", "#s2")[(i + j) % 4] if "/" in front else ""
                yield " " * (i % 3) + front + pid + (f"v{version}" if version else "") + tail, pid, version


def test_canonical_ref_reads_every_form(spark):
    forms = list(reference_forms())
    rows = spark.createDataFrame([(i, f[0]) for i, f in enumerate(forms)], "i int, x string").select("i", refs.canonical_ref(F.col("x")).alias("r"))
    got = {r.i: (r.r.kind, r.r.id, r.r.version) for r in rows.collect()}
    assert len(forms) > 300 and got == {i: ("id", pid, version) for i, (_, pid, version) in enumerate(forms)}


@pytest.mark.parametrize("ref", ["Rivers and Their Names", "2211", "https://openreview.net/forum?id=abc"])
def test_other_refs_are_titles_and_blank_is_an_error(spark, ref):
    assert one(spark, ref, refs.canonical_ref).kind == "title"
    assert one(spark, "   ", refs.canonical_ref).kind == "error"


@pytest.mark.parametrize("url, ok", [("https://arxiv.org/html/x", True), ("http://arxiv.org/html/x", False), ("https://evil.example/arxiv.org/x", False), ("https://arxiv.org.evil.example/x", False), ("file:///etc/passwd", False)])
def test_allowed_host(spark, url, ok):
    assert one(spark, url, lambda c: refs.allowed_host(c, ["arxiv.org"])) is ok


def test_labels_secrets_and_types(spark):
    assert one(spark, "a\r\nb\n\nc", text.sanitize_label) == "a\\nb\\nc" and one(spark, "arr[0]", text.sanitize_label) == "arr(0)" and one(spark, "\n\nx\n", text.sanitize_label) == "x"
    out = one(spark, "--api-key=hunter2 --token abc https://u:pw@host/x", text.redact_secrets)
    assert "hunter2" not in out and "abc" not in out and "u:pw@" not in out and "[REDACTED]" in out
    kinds = spark.createDataFrame([(b"\x89PNG\r\n\x1a\nrest",), (b"\xff\xd8\xff\xe0rest",), (b"%PDF-1.4",), (b'<?xml version="1.0"?><svg xmlns="s">',), (b"hello",)], "b binary")
    assert [r[0] for r in kinds.select(refs.sniff_type(F.col("b"))).collect()] == ["png", "jpeg", "pdf", "svg", None]


SOURCE = "---\nkind: Note\n---\n\n# Heading\n\nYield fell from 63.5% to 12.8% over 917 plots in 2021.\n\n$$m=\\sum_i w_i$$\n\n| k | l |\n|---|---|\n| 55.5 | 2 |\n\n## References\n\n- Y (2019) 45.6\n"


def test_number_presence_names_what_a_derived_text_lost(spark):
    src = spark.createDataFrame([("d", SOURCE)], "doc string, text string")
    assert sorted(one(spark, SOURCE, text.extract_numbers)) == ["12.8%", "63.5%", "917"]
    bad = spark.createDataFrame([("d", "short note 12.8%")], "doc string, text string")
    lost = coverage.number_presence(src, bad, "doc", "text").collect()
    assert sorted(r.token for r in lost if r.kind == "number") == ["63.5%", "917"] and sum(r.kind == "equation" for r in lost) == 1
    good = spark.createDataFrame([("d", "63.5% to 12.8%, 917 plots. $m=\\sum_i w_i$ done")], "doc string, text string")
    assert coverage.number_presence(src, good, "doc", "text").count() == 0


def test_bare_numbers(spark):
    tex = (
        "% remark with 77 in it\nThe method gets \\result{q4/z/f1}{mean}{1} (\\result{q4/z/f1}{n}{0} runs),\nabove \\nonresult{0.52}{\\cite{d2023} Table 1} of~\\cite{d2023}.\n"
        "\\begin{tabular}{rr} \\multicolumn{3}{l}{y} \\\\ \\cmidrule(lr){2-3}\nLine & 0.47 & \\result{q4/z/f1}{std}{2} \\\\ \\end{tabular}\n"
        "\\includegraphics[width=0.8\\textwidth]{plots/f1.pdf} In Section~\\ref{sec:9} and Figure~4.\nRun for 250 steps.\\vspace{3mm}\nDelay 9ms and $y_2 = 3/4$ and the 5th try, A40 cards, BERT-2.\n\\multirow{3}{*}{0.71} \\parbox{4cm}{0.58}\n"
    )
    rows = latex.bare_numbers(spark.createDataFrame([("f", tex)], "file string, tex string"), "tex", "file").collect()
    assert [(r.line, r.number) for r in rows] == [(5, "0.47"), (6, "4"), (7, "250"), (8, "9ms"), (8, "3"), (8, "4"), (9, "0.71"), (9, "0.58")]


def test_cite_keys_variants(spark):
    tex = "\\cite {alpha}\n\\citep{beta,\n  gamma}\n\\parencites{delta}{eps}\n\\citetalias{zeta} \\nocite{eta} \\citet*[p. 8]{theta}\n"
    rows = latex.cite_keys(spark.createDataFrame([("f", tex)], "file string, tex string"), "tex", "file").collect()
    assert {(r.key, r.line) for r in rows} == {("alpha", 1), ("beta", 2), ("gamma", 2), ("delta", 4), ("eps", 4), ("zeta", 5), ("eta", 5), ("theta", 5)}


def test_bibliography_and_citation_resolution(spark):
    bib = '@inproceedings{v, title = {Rivers}, eprint = {1801.00001}, archivePrefix = {arXiv}}\n@article{p, journal = {draft arXiv:2302.04321}, year = 2023}\n@article{w, url = {https://arxiv.org/abs/2404.09876v1}}\n@article{u, note={arXiv:2109.00001}}\n@book(k, title = "B (c)", year = {1991})\n@book{n, title = {x}}'
    fields = latex.reference_fields(spark.createDataFrame([("b", bib)], "file string, bib string"), "bib", "file")
    assert {(r.field, r.value) for r in fields.filter("key = 'k'").collect()} == {("title", "B (c)"), ("year", "1991")}
    papers = latex.reference_papers(fields, "file")
    keys = fields.select("file", "key").distinct().join(papers, ["file", "key"], "left").select("key", "paper", "version")
    cites = spark.createDataFrame([("t:1", k) for k in "vpwuknx"], "location string, key string")
    sources = spark.createDataFrame([("1801.00001", 7, "html"), ("2302.04321", 1, "pdf"), ("2404.09876", 2, "html")], "paper string, saved_version int, route string")
    out = {r.key: r for r in findings.resolve_citations(cites, keys, sources, spark.createDataFrame([("k",)], "key string")).collect()}
    assert set(out) == {"p", "w", "u", "n", "x"} and out["p"].severity == "warning" and all(out[k].severity == "major" for k in "wunx")
    assert "v1" in out["w"].message and "v2" in out["w"].message


def test_page_blocks_footnotes_and_spans(spark):
    html = '<nav>skip</nav><article><h1>One</h1><p id="p1">Main text<span class="ltx_note ltx_role_footnote" id="fn1"><sup class="ltx_note_mark">1</sup><span class="ltx_note_outer"><span class="ltx_note_content"><sup class="ltx_note_mark">1</sup><span class="ltx_tag ltx_tag_note">1</span>Note body here</span></span></span> continues.<p>Second &amp; open</article>'
    b = pages.page_blocks(spark.createDataFrame([(1, html)], "doc int, html string"), "doc", "html").collect()
    assert [(r.kind, r.text) for r in b] == [("heading", "One"), ("paragraph", "Main text continues."), ("paragraph", "Second & open"), ("footnote", "Note body here")]
    table = '<table><tr><th rowspan="2">a</th><th colspan="2">b</th></tr><tr><td>c</td><td rowspan="2">d</td></tr><tr><td>e</td><td>f</td></tr></table>'
    cells = pages.page_tables(spark.createDataFrame([(1, table)], "doc int, html string"), "doc", "html").collect()
    assert {(r.row, r.col, r.text) for r in cells} == {(0, 0, "a"), (1, 0, "a"), (0, 1, "b"), (0, 2, "b"), (1, 1, "c"), (1, 2, "d"), (2, 2, "d"), (2, 0, "e"), (2, 1, "f")}


def test_readers(spark, folder):
    os.makedirs(f"{folder}/docs"), os.makedirs(f"{folder}/runs/r001"), os.makedirs(f"{folder}/claims"), os.makedirs(f"{folder}/atom")
    open(f"{folder}/docs/a.md", "w").write("---\ntype: Paper\ntitle: 'T one'\narxiv: {id: '1706.03762', version: 7}\n---\n\nbody\n---\nmore")
    open(f"{folder}/docs/b.md", "w").write("no head")
    rows = {r.body: r for r in files.read_documents(spark, f"{folder}/docs", ["title", "arxiv.id", "arxiv.version"]).collect()}
    assert rows["no head"].title is None and rows["body\n---\nmore"].title == "T one" and rows["body\n---\nmore"].arxiv_version == "7"
    open(f"{folder}/runs/r001/results.json", "w").write('{"schema_version": 1, "observations": [{"condition": "a", "seed": 1, "metrics": {"acc": "0.7100"}}]}')
    assert [tuple(r) for r in files.read_results(spark, f"{folder}/runs/*/results.json").collect()] == [("r001", "a", 1, "acc", "0.7100")]
    open(f"{folder}/claims/C01.json", "w").write('{"kind": "hypothesis", "claim_status": "dropped"}')
    assert files.read_ledger(spark, f"{folder}/claims", "claim").select("id", "claim_status").collect() == [("C01", "dropped")]
    entry = '<entry><id>http://arxiv.org/abs/hep-th/9901001v3</id><title>A\n  title</title><author><name>X Y</name></author><author><name>Z</name></author><category term="cs.CL"/><arxiv:comment xmlns:arxiv="u">c</arxiv:comment></entry>'
    open(f"{folder}/atom/f.xml", "w").write(f'<feed xmlns="http://www.w3.org/2005/Atom">{entry}</feed>')
    e = files.read_atom(spark, f"{folder}/atom").head()
    assert (e.id, e.version, e.title, e.authors, e.categories, e.comment) == ("hep-th/9901001", 3, "A title", ["X Y", "Z"], ["cs.CL"], "c")
    sizes = {r.path: r.size for r in files.hash_files(spark, f"{folder}/claims").collect()}
    assert list(sizes) == ["C01.json"] and sizes["C01.json"] > 10


def test_index_golden_and_empty(spark, folder):
    notes = spark.createDataFrame([("2503.17523", "Note title", "It generalises.", "draft", "human:a")], "id string, title string, description string, status string, verified_by string")
    sources = spark.createDataFrame(
        [("2503.17523", 3, "Bayesian", "Models are used. To do so more.", "2025-03-21", "html", "process:check"), ("2607.05775", 1, "A PDF-only Paper", "Short abstract here.", "2026-07-08", "pdf", None)],
        "id string, version int, title string, description string, published string, route string, verified_by string",
    )
    reports.write_index(reports.index_lines(notes, sources, "t"), f"{folder}/index")
    got = "".join(open(f"{folder}/index/{p}").read() for p in sorted(os.listdir(f"{folder}/index")) if p.startswith("part-"))
    assert got.splitlines()[4:] == [
        "# Notes", "", "* [Note title](2503.17523.md) (human-reviewed; draft) - It generalises.", "", "# Sources", "",
        "* [A PDF-only Paper](sources/2607.05775.md) (arXiv:2607.05775v1; 2026-07-08; unverified; route:pdf) - Short abstract here.",
        "* [Bayesian](sources/2503.17523.md) (arXiv:2503.17523v3; 2025-03-21; machine-confirmed) - Models are used.",
    ]
    empty = [r.line for r in reports.index_lines(notes.limit(0), sources.limit(0)).collect()]
    assert reports.NO_NOTES in empty and reports.NO_SOURCES in empty


def published(spark, path, schema="v int, k string"):
    return sorted(((r.v, r.k) for r in reports.read_published(spark, path, spark.createDataFrame([], schema).schema, "k").collect()), key=repr)


def test_readers_see_a_publication_whole_or_not_at_all(spark, folder):
    table = f"{folder}/t"
    assert published(spark, table) == []
    reports.publish(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "v int, k string"), table, "k")
    first = [(1, "a"), (2, "b"), (3, None)]
    assert published(spark, table) == first
    # One of two parts is written before the other fails: nobody sees it.
    half = spark.range(2, numPartitions=2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("boom")).cast("int")).otherwise(8).alias("v"), F.lit("a").alias("k"))
    with pytest.raises(Exception):
        reports.publish(half, table, "k")
    assert published(spark, table) == first
    # A full version without its pointer is not there either.
    spark.createDataFrame([(7, "b")], "v int, k string").write.parquet(f"{table}/rows-orphan")
    assert published(spark, table) == first
    reports.publish(spark.createDataFrame([(9, "a"), (10, "a")], "v int, k string"), table, "k")
    assert published(spark, table) == [(10, "a"), (2, "b"), (3, None), (9, "a")]
    for i in range(6):
        reports.publish(spark.createDataFrame([(20 + i, None)], "v int, k string"), table, "k", layers=2)
    assert published(spark, table) == [(10, "a"), (2, "b"), (25, None), (9, "a")]
    assert len(reports._layers(spark, table)[1]) <= 2 and not [d for d in os.listdir(table) if "=" in d]


def test_payloads_stand_once_and_resolve(spark):
    rows = [(1, "x" * 50), (2, "short"), (3, "x" * 50), (4, None), (5, "y" * 41)]
    events = spark.createDataFrame(rows, "id int, payload string")
    log = files.event_log(events, ["id"], "payload", 40, parts=2)
    one = files.payload_store(events.filter("id < 3"), "payload", 40)
    store = one.unionByName(files.payload_store(events, "payload", 40, one))
    assert store.count() == 2
    assert sorted((r.id, r.payload) for r in files.resolve(log, store, "payload").collect()) == rows
    assert {r.id: r.payload for r in files.resolve(log, one, "payload").collect()}[5] is None
