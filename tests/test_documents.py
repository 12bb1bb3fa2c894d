"""Parser, macros, edits, projects, readiness, incremental work, readers, governance and learning on small inputs."""

import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
import pytest

from proofmill import session
from proofmill.operators import edits as ed
from proofmill.operators import governance as gov
from proofmill.operators import graphs, incremental, learning, macros, parsing, projects, readiness
from proofmill.sources import binary, files, sinks


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"d/f{i}.tex", t, "en") for i, t in enumerate(texts)], "doc_id bigint, path string, text string, lang string")


HARD = [
    "a % $x\n$y$ \\verb|$| $$z$$ \\% \\(q\\) \\begin{align*}a\\begin{split}b\\end{split}\\end{align*} \\url{a_$b}",
    "{open \\begin{a} {x} \\end{b} } } $", "\\begin{verbatim}\n$a$ % \\end{x}\n\\end{verbatim} $b\n\nc$ \\\\[2pt] \\$5", "", "\\", "\\end{q}\\begin{x}{", "é\r\n\t\u2028b{" * 3, "{" * 700 + "x",
]


def test_regions():
    kinds = [(k, HARD[0][a:b]) for k, a, b in parsing.all_regions(HARD[0])]
    assert kinds == [("comment", "% $x"), ("inline", "$y$"), ("verbatim", "\\verb|$|"), ("display", "$$z$$"), ("inline", "\\(q\\)"), ("display", "\\begin{align*}a\\begin{split}b\\end{split}\\end{align*}"), ("address", "\\url{a_$b}")]
    assert [k for k, _, _ in parsing.all_regions(HARD[2])] == ["verbatim"]  # a blank line ends inline mathematics


@pytest.mark.parametrize("text", HARD)
def test_leaves_hold_every_character(text):
    out, at = parsing.parse(text), 0
    for _, kind, _, a, b, _ in out.rows:
        if kind not in ("group", "environment"):
            assert a == at and b > a
            at = b
    assert at == len(text)


def test_nodes_and_zones(spark):
    d = docs(spark, *HARD, None, "good one\n\nbad } here\n\nnext\n\nlast", "\\begin{figure}\\label{f}\\end{figure}\\label{g}")
    assert parsing.round_trip(d).where("not same").count() == 0 and parsing.round_trip(d).count() == len(HARD) + 2
    errors = {(r.doc_id, r.error) for r in parsing.parse_errors(d).collect()}
    assert {(1, "end without begin"), (1, "environment not closed"), (1, "mathematics not closed"), (1, "brace without opener")} - {(1, "brace without opener")} <= errors
    k = len(HARD) + 1
    assert [r.zone for r in parsing.trust_zones(d).where(f"doc_id = {k}").orderBy("pos").collect()] == ["partial", "broken", "partial", "complete"]
    assert {r.key: r.environment for r in parsing.labels_by_environment(d).collect()} == {"f": "figure", "g": None}
    p = parsing.recovery_points(d).where(f"doc_id = {k}").first()
    assert p.kind == "paragraph" and p.point == len("good one")
    assert parsing.nodes(d.limit(0)).count() == 0


def test_leaves_in_bounded_batches_and_without_a_join(spark, monkeypatch):
    given = []
    monkeypatch.setattr(parsing, "map_arrow", lambda df, fn, schema: given.append(fn) or session.map_arrow(df, fn, schema))
    d = docs(spark, "a b $c$ " * 50, "", None)
    parsing.leaves(d)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": ["a b $c$ " * 50] * 3000})
    sizes = [b.num_rows for b in given[0]([batch])]
    assert sum(sizes) == 3000 * 300 and max(sizes) < 250_000
    again = parsing.round_trip(d)
    assert {(r.doc_id, r.n_leaves, r.same) for r in again.collect()} == {(0, 300, True), (1, 0, True)}
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_macros(spark):
    text = r"\newcommand{\R}{\mathbb{R}}\newcommand{\pair}[2]{(#1, #2)}\def\a{\b}\def\b{\a}\newcommand{\opt}[2][x]{#1-#2}\newcommand{\begin}{no} \pair{\R}{$\frac{1}{2}$} \opt{y} \opt[z]{w} % \R"
    d = docs(spark, text, None, "plain", r"\def\grow{x\grow}\grow")
    defs = macros.definitions(d)
    assert [(r.name, r.arity, r.allowed) for r in defs.where("doc_id = 0").orderBy("pos").collect()] == [("R", 0, True), ("pair", 2, True), ("a", 0, True), ("b", 0, True), ("opt", 2, True), ("begin", 0, False)]
    assert {(r.doc_id, r.name) for r in macros.macro_cycles(defs).collect()} == {(0, "a"), (0, "b"), (3, "grow")}
    got = {r.doc_id: r for r in macros.expand(d).collect()}
    assert got[0].expanded.strip() == r"(\mathbb{R}, $1/2$) x-y z-w % \R" and got[0].settled and got[2].passes == 0
    assert set(got) == {0, 2, 3} and not got[3].settled


def test_edits(spark):
    d = docs(spark, "abcdef", "same", None)
    e = spark.createDataFrame([(0, 1, 0, 2, "X"), (0, 2, 1, 3, "Y"), (0, 3, 3, 3, "i"), (0, 4, 3, 3, "j"), (0, 5, 0, 2, "X"), (0, 6, 99, 100, "no"), (0, 7, 1, 1, "in"), (0, 8, None, 3, "n")], "doc_id bigint, no int, start int, end int, replacement string")
    assert {(r.a, r.b) for r in ed.conflicts(e).collect()} == {(1, 2), (2, 5), (1, 7), (5, 7)}
    got = {r.doc_id: (r.edited, r.n_made) for r in ed.apply_edits(d, e).collect()}
    assert got == {0: ("Xcijdef", 3), 1: ("same", 0)}
    messy = "a  b...\t$x  y$ \n\n\n\n\n% c  d\n\"q\" \ufeff"
    fixed = {r.doc_id: r for r in ed.fix_all(docs(spark, messy, "clean", None)).collect()}
    assert fixed[0].fixed == "a b\\dots{} $x  y$\n\n\n% c  d\n``q\"" and fixed[0].ended == "clean" and fixed[1].n_edits == 0
    s = spark.createDataFrame([(5, 8, 0, 2, "xyz"), (5, 8, 8, 9, ""), (5, 8, 6, 7, "")], "s int, e int, a int, b int, r string").select(ed.shifted(*map(F.col, "seabr")).alias("x")).select("x.*")
    assert [tuple(r) for r in s.collect()] == [(6, 9, False), (5, 8, False), (5, 8, True)]
    t = spark.createDataFrame([("abcXdef", "abcYYdef"), ("aa", "aaa"), ("", "x"), ("s", "s")], "o string, n string").select(ed.dirty_region(F.col("o"), F.col("n")).alias("x")).select("x.*")
    assert [tuple(r) for r in t.collect()] == [(3, 4, 5), (2, 2, 3), (0, 0, 1), (1, 1, 1)]


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("x", "a"), ("d", "f"), (None, "a"), ("a", "b")], "src string, dst string")
    assert {r.node for r in graphs.cycles(e).collect()} == {"a", "b", "c", "e"}
    got = {(r.start, r.node) for r in graphs.reachable(e, spark.createDataFrame([("d",), ("x",)], "s string")).collect()}
    assert got == {("d", "f")} | {("x", n) for n in "abcdf"}
    levels, left = graphs.peeled(e)
    assert {r.node: r.level for r in levels.collect()} == {"f": 0, "d": 1} and left.count() == 5
    assert graphs.cycles(e.limit(0)).count() == 0


def test_projects(spark):
    rows = [("main.tex", "\\documentclass{a}\\input{ch/one} % \\input{no}\n\\include{two}\\include{gone}\\includegraphics[w]{fig}\\bibliography{r}\\label{k}"), ("ch/one.tex", "\\input ../shared.tex \\label{k}"), ("two.tex", "\\input{main}"), ("shared.tex", "x"), ("only.tex", "\\includeonly{two}\\include{one}\\include{two}"), ("n.tex", None)]
    d = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.target): r.file for r in projects.resolved_includes(d).collect()}
    assert got == {("main.tex", "ch/one"): "ch/one.tex", ("main.tex", "two"): "two.tex", ("main.tex", "gone"): None, ("ch/one.tex", "../shared.tex"): "shared.tex", ("two.tex", "main"): "main.tex", ("only.tex", "two"): "two.tex"}
    assert {r.node for r in projects.include_cycles(d).collect()} == {"main.tex", "two.tex"}
    assert {r.node: r.level for r in projects.build_order(d).collect()} == {"shared.tex": 0, "ch/one.tex": 1, "n.tex": 0}
    assert {(r.start, r.node) for r in projects.include_closure(d).collect()} >= {("only.tex", "shared.tex"), ("main.tex", "main.tex")}
    assert {(r.src, r.dst) for r in projects.build_artefacts(d).collect()} == {("main.tex", "main.aux"), ("main.aux", "main.pdf"), ("main.aux", "main.bbl"), ("main.bbl", "main.pdf")}
    f = projects.resolved_graphics(d, spark.createDataFrame([("fig.png",), ("fig.pdf",)], "file string")).first()
    assert f.file == "fig.pdf" and projects.shared_across_files(d).first()["n_files"] == 2


def test_readiness(spark):
    good = "\\documentclass{a}\n\\begin{document}\nx $a$\n\\end{document}"
    d = docs(spark, good, good.replace("x", "\\write18{ls} x^a^b \\label{l}\\label{l} \\input{gone}"), "\\end{q}", None)
    got = {(r.doc_id, r.step, r.reason) for r in readiness.reasons(d).collect()}
    assert {r.doc_id for r in readiness.ready(d).collect()} == {0}
    assert {(1, "tier", "foreign feature shell-escape"), (1, "labels", "label set twice: l"), (1, "includes", "nothing found for gone"), (1, "structure", "script upon script"), (2, "parse", "end without begin"), (2, "structure", "no document class")} <= got
    severe = spark.createDataFrame([(0, "ENC-001")], "doc_id bigint, rule_id string")
    assert readiness.ready(d, severe).count() == 0
    e = d.withColumn("engine", F.lit("XeLaTeX")).withColumn("text", F.lit("\\usepackage[utf8]{inputenc, babel}"))
    assert readiness.incompatible_packages(e).select("package").distinct().collect()[0][0] == "inputenc"
    v = readiness.compile_verdicts(spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "a", True)], "doc_id bigint, claim string, holds boolean"))
    assert {tuple(r) for r in v.collect()} == {(1, False, 1), (2, True, 0)}


def test_incremental(spark):
    d = docs(spark, "\\label{a} short\n\nx" + "y" * 80 + "\n\n\\ref{a}" + "z" * 70 + "\n\n\\newcommand{\\m}{1}" + "w" * 60 + "\n\n\\m \\ref{a}", "", None)
    c = incremental.merged_chunks(d)
    got = {r.chunk_no: r for r in c.collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[1].start == got[0].length + 2
    whole = d.first()["text"]
    assert all(whole[r.start : r.start + r.length] == r.content for r in got.values())
    e = incremental.chunk_edges(c)
    assert {(r.src, r.dst, r.kind) for r in e.collect()} == {(0, 1, "label"), (0, 3, "label"), (2, 3, "macro")}
    dirty = spark.createDataFrame([(0, 0)], "doc_id bigint, chunk_no int")
    assert {r.chunk_no for r in incremental.affected_chunks(e, dirty).collect()} == {0, 1, 3}
    t = incremental.work_order(spark.createDataFrame([("A", 10, 0), ("B", 0, 0), ("A", 0, 1)], "execution_class string, chunk_start int, layer int"), 4)
    assert sorted(r.priority for r in t.collect()) == [6, 1004, 1000004]
    s = lambda *x: spark.createDataFrame([(1, v) for v in x], "doc_id bigint, sentence string")
    assert {tuple(r)[1:] for r in incremental.sentence_changes(s("a", "b"), s("b", "c", "c")).collect()} == {("a", "removed"), ("c", "added")}
    v = spark.createDataFrame([(1, 0, 5, None), (1, 1, 2, 5), (1, 2, 9, 1)], "doc_id bigint, layer int, gen int, parent_gen int")
    assert {r.layer: r.consistent for r in incremental.consistent_layers(v).collect()} == {0: True, 1: True, 2: False}
    known = c.where("chunk_no = 0").select("hash", F.lit("R-1").alias("rule_id"), F.lit(2).alias("n"))
    hit, todo = incremental.cached_findings(c, known)
    assert hit.count() == 1 and todo.count() == 3


def test_logs_and_auxiliary_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("This is XeTeX, Version 3\nOverfull \\hbox (12.5pt too wide) in paragraph at lines 3--7\nUnderfull \\vbox (badness 10000) detected at line 9\n[1] [2]\nLaTeX Warning: Citation `k' on page 1 undefined on input line 4.\nLaTeX Warning: Float too large for page by 3.0pt on input line 8.\nLaTeX Font Warning: Font shape `OT1/x' undefined\nLaTeX Warning: Label(s) may have changed. Rerun to get it right.\nLaTeX Warning: odd on input line 5.\ncompile time for picture: 6.5 s\n")
    ev = files.log_events(files.text_lines(spark, str(tmp_path / "a.log")))
    got = [(r.kind, r.box, r.amount_pt, r.line_start, r.page, r.event_key) for r in ev.orderBy("line_no", "page").collect()]
    assert ("Overfull", "hbox", 12.5, 3, None, None) in got and ("PageNumber", None, None, None, 2, None) in got and ("CitationUndefined", None, None, None, None, "k") in got and ("CompileTime", None, 6.5, None, None, None) in got
    kinds = [g[0] for g in got]
    assert kinds.count("LatexWarning") == 2 and kinds.count("FloatWarning") == 1 and kinds.count("RerunNeeded") == 1 and kinds.count("FontSubstitution") == 1
    log = files.text_files(spark, str(tmp_path / "a.log"))
    assert files.engines(log.withColumnRenamed("path", "file")).first()["engine"] == "XeLaTeX"
    src = log.select(F.regexp_replace("path", "log$", "tex").alias("path"), (F.col("modified") + F.expr("interval 1 hour")).alias("modified"))
    assert files.stale_logs(src, log).count() == 1 and files.stale_logs(log, src).count() == 0
    (tmp_path / "a.aux").write_text("\\newlabel{s:a}{{1.2}{3}{A {b}}{x}{}}\n\\newlabel{bad\n\\bibcite{key}{7}\n\\bibstyle{plain}\n\\bibdata{r1, r2}\n")
    aux = files.text_lines(spark, str(tmp_path / "a.aux"))
    assert [(r.name, r.ref_number, r.page_number) for r in files.aux_labels(aux).collect()] == [("s:a", "1.2", "3")]
    assert files.aux_citations(aux).first()["number"] == "7" and files.aux_warnings(aux).count() == 1
    assert files.aux_settings(aux).first()["databases"] == ["r1", "r2"]
    (tmp_path / "m.txt").write_text("# list\na.tex\n\n b.tex \na.tex\n")
    assert {r.file for r in files.manifest(spark, str(tmp_path / "m.txt")).collect()} == {"a.tex", "b.tex"}
    (tmp_path / "g.jsonl").write_text('{"file": "a", "expect": ["X"]}\n')
    assert files.golden_cases(spark, str(tmp_path / "g.jsonl")).first()["expect"] == ["X"]
    (tmp_path / "c.json").write_text('[{"rule_id": "A", "layer": "L0"},\n {"rule_id": "B"}]')
    assert files.json_catalogue(spark, str(tmp_path / "c.json"), "rule_id string, layer string").count() == 2


def _chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_binary_metadata(spark):
    png = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 40, 30, 8, 6, 0, 0, 0)) + _chunk(b"pHYs", struct.pack(">IIB", 23622, 23622, 1)) + _chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\1" + struct.pack(">HH", 72, 72) + b"\0\0" + b"\xff\xee" + struct.pack(">H", 14) + b"Adobe" + bytes(6) + b"\2" + b"\xff\xc0" + struct.pack(">HBHHB", 20, 8, 10, 20, 4) + bytes(12) + b"\xff\xd9"
    packed = zlib.compress(b"<< /Type /Page /Lang (de) >>")
    pdf = b"%PDF-1.5\n1 0 obj << /Type /Catalog /MarkInfo << >> >> endobj\n2 0 obj << /Type /Page >> endobj\n3 0 obj << /Type /Font /BaseFont /ABC+Foo >> endobj\n4 0 obj << /Length 3 >> stream\nabc\nendstream endobj\n5 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj\n"
    seg = struct.pack(">HHHHHHH", 4, 0, 0, 4, 0, 0, 0) + struct.pack(">2H", 0x9FFF, 0xFFFF) + b"\0\0" + struct.pack(">2H", 0x3041, 0xFFFF) + bytes(8)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + seg
    font = b"\x00\x01\x00\x00" + struct.pack(">HHHH", 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap
    rows = [("p.png", bytearray(png)), ("j.jpg", bytearray(jpeg)), ("d.pdf", bytearray(pdf)), ("f.ttf", bytearray(font)), ("x", bytearray(b"x")), ("cut.png", bytearray(png[:20])), ("none", None)]
    info = binary.file_metadata(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.path: r for r in info.collect()}
    assert (got["p.png"].width, got["p.png"].height, got["p.png"].transparent, round(got["p.png"].dpi_x)) == (40, 30, True, 600)
    assert (got["j.jpg"].colors, got["j.jpg"].width, got["j.jpg"].dpi_x) == ("ycck", 20, 72.0)
    assert (got["d.pdf"].pages, got["d.pdf"].lang, got["d.pdf"].fonts_not_embedded, got["d.pdf"].streams_plain) == (2, "de", 1, 1)
    assert got["f.ttf"].covers_cjk and got["x"].format == got["none"].format == got["cut.png"].format == "unknown"
    found = {(r.path, r.rule_id) for r in binary.metadata_findings(info).collect()}
    assert {("p.png", "FIG-004"), ("p.png", "FIG-006"), ("j.jpg", "COL-001"), ("d.pdf", "PDF-006"), ("d.pdf", "PDF-011"), ("d.pdf", "TIKZ-008")} <= found and ("d.pdf", "PDF-009") not in found


def test_governance(spark):
    lines = ["profile house # x", "disable A-1", "enable A-1", "disable B-1", "severity C-1 error", 'waive C-1 file=d/* reason="old text"', "waive C-1 file=*.tex", "nonsense", "severity C-1 loud", "", "disable"]
    p = gov.policy_lines(spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string"))
    assert {r.error for r in p.collect()} == {None, "unknown directive", "unknown severity", "argument missing"} and p.where("line_no = 5").first()["reason"] == "old text"
    f = spark.createDataFrame([(1, "A-1", "Info", "d/a.tex"), (2, "B-1", "Info", "x"), (3, "C-1", "Info", "q/b.tex"), (4, "D-1", "Info", None), (5, "C-1", "Info", "d/x.txt")], "doc_id bigint, rule_id string, severity string, path string")
    got = {r.doc_id: (r.severity, r.waived_by) for r in gov.apply_policy(f, p).collect()}
    assert got == {1: ("Info", None), 3: ("Error", 6), 4: ("Info", None), 5: ("Error", 5)}
    assert {r.line_no for r in gov.unused_directives(f.where("doc_id <> 2"), p).collect()} == {3}
    r = gov.review_lines(spark.createDataFrame([("r", 1, "review A-1 resolved owner=me"), ("r", 2, "review C-1 acknowledged owner=you file=q/*"), ("r", 3, "review C-1 odd owner=x"), ("r", 4, "review D-1 new")], "file string, line_no int, line string"))
    assert [x.error for x in r.orderBy("line_no").collect()] == [None, None, "unknown state", "owner missing"]
    assert {x.doc_id: (x.state, x.owner) for x in gov.annotate_reviews(f, r).collect()} == {2: ("new", "-"), 3: ("acknowledged", "you"), 4: ("new", "-"), 5: ("new", "-")}
    m = gov.extension_manifests(spark.createDataFrame([("a", '{"name":"a","provides":["x"],"requires":["y"],"support":"partial"}'), ("b", '{"name":"b","provides":["z"],"support":"proven"}'), ("c", "{"), ("d", '{"name":"d","support":"great"}')], "file string, text string"))
    assert {x.file: x.error for x in m.collect()} == {"a": None, "b": None, "c": "name missing", "d": "unknown support"}
    u = gov.evaluate_extensions(m, spark.createDataFrame([(1, "x"), (1, "z"), (2, "z"), (3, "q")], "doc_id bigint, feature string"))
    assert {x.doc_id: x.support for x in u.collect()} == {1: "partial", 2: "proven", 3: "unsupported"}
    assert [tuple(x) for x in gov.over_claims(m).collect()] == [("a", "x")]
    e = gov.weigh_by_evidence(f.withColumn("weight", F.lit(1.0)), spark.createDataFrame([("A-1", 0.5, False), ("B-1", 1.0, True)], "rule_id string, weight double, suppress boolean"))
    assert {x.doc_id: x.weight for x in e.collect()} == {1: 0.5, 3: 1.0, 4: 1.0, 5: 1.0}
    c = spark.createDataFrame([(1, ["A"], ["B"]), (2, ["A"], ["B"]), (3, None, None)], "case_id bigint, expect array<string>, forbid array<string>")
    g = gov.golden_results(c, spark.createDataFrame([(1, "A"), (2, "A"), (2, "B")], "case_id bigint, rule_id string"))
    assert {x.case_id: x.passed for x in g.collect()} == {1: True, 2: False, 3: True}


def test_learning(spark):
    d = docs(spark, "x" * 700, "ab", "", None)
    w = [(r.doc_id, r.start, len(r.window)) for r in learning.text_windows(d).orderBy("doc_id", "start").collect()]
    assert w == [(0, 0, 300), (0, 150, 300), (0, 300, 300), (0, 450, 250), (1, 0, 2)]
    b = spark.createDataFrame([(bytearray(b"abcdef"), 5), (bytearray(range(200)), 100), (bytearray(range(200)), 199)], "s binary, at int").select(learning.byte_window(F.col("s"), F.col("at"), 8).alias("w"))
    assert [bytes(r.w) for r in b.collect()] == [b"abcdef\0\0", bytes(range(96, 104)), bytes(range(192, 200))]
    p = spark.createDataFrame([(0, 3), (0, 9)], "doc_id bigint, at int")
    s = learning.parser_state(docs(spark, "a $b$ \\begin{q}c\\end{q}"), p.union(spark.createDataFrame([(0, 16), (7, 1)], p.schema)))
    assert [(r.in_math, r.env_depth) for r in s.orderBy("doc_id", "at").collect()] == [(True, 0), (False, 1), (False, 1), (False, 0)]
    t = spark.range(1).select(learning.bio_tags(F.lit(6), F.expr("array(named_struct('span_start',1,'span_end',4,'rule_id','r'), named_struct('span_start',2,'span_end',3,'rule_id','s'))")).alias("t")).first()["t"]
    assert t == ["O", "B-r", "B-s", "I-r", "O", "O"]
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("rule"))
    out = learning.stratified_split(rows, "rule", "id")
    n = {(r.rule, r.split): r.n for r in out.groupBy("rule", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert out.count() == 2000 and all(abs(n[k, "train"] / sum(n[k, s] for s in ("train", "dev", "test")) - 0.7) < 0.01 for k in (None, "0", "1"))
    assert {r.missing for r in learning.split_statistics(out, "split", "rule").collect()} == {0}
    m = learning.averaged_metrics(spark.createDataFrame([("a", 3, 1, 0), ("b", 0, 0, 2)], "rule_id string, tp bigint, fp bigint, fn bigint")).first()
    assert tuple(m) == (0.75, 0.6, 0.6667, 0.4286)
    c = learning.tag_confusion(spark.createDataFrame([(["O", "B"], ["O", "O", "B"]), (None, ["O"])], "t array<string>, g array<string>"), "t", "g")
    assert {tuple(r) for r in c.collect()} == {("O", "O", 1), ("B", "O", 1)}
    q = learning.latency_percentiles(spark.range(101).select(F.lit("k").alias("k"), "id"), "k", "id").first()
    assert (q.n, q.p50, q.p95) == (101, 50.0, 95.0)
    cand = spark.range(200).select(F.col("id").alias("candidate_id"), F.lit("r").alias("rule_id"), (F.col("id") % 2).cast("int").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(128)), lambda k: F.when(F.col("id") % 2 == 1, 92).otherwise(97)).alias("bytes"), F.lit(60).alias("anchor_start"), *(F.lit(False).alias(k) for k in ("in_math", "in_verbatim", "in_comment")), F.lit(1).alias("env_depth"))
    v = learning.candidate_vectors(cand)
    assert learning.judged(learning.baseline(v), v).where("label <> predicted").count() == 0


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("A-1", "Info", 2, "a\tb\nc"), ("B-1", "Error", 1, None)], "rule_id string, severity string, n bigint, message string")
    sinks.write_findings_tsv(f.coalesce(1), f"{tmp_path}/t")
    assert sorted(spark.read.text(f"{tmp_path}/t").toPandas()["value"]) == ["A-1\tInfo\t2\ta b c", "B-1\tError\t1\t"]
    sinks.write_candidates(ed.fix_edits(docs(spark, "a  b")), f"{tmp_path}/c")
    assert {r.value for r in spark.read.text(f"{tmp_path}/c").collect()} == {"CANDIDATE\t0\tTYPO-018", 'EDIT\t1\t3\t{"replacement":" "}'}
    sinks.write_report(f, f"{tmp_path}/r"), sinks.write_report(f, f"{tmp_path}/s", "tsv"), sinks.write_records(f, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/r").count() == spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/s").count() == 2 == spark.read.json(f"{tmp_path}/j").count()
