"""Names, structure, findings and joins on small inputs."""

from pyspark.sql import functions as F

from proofmill.functions.paths import file_name, file_source
from proofmill.operators import findings as fo
from proofmill.operators import structure as st
from proofmill.operators.components import connected_components
from proofmill.operators.skew import salted_join
from proofmill.plans.registry import all_rules, findings, required_literal


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")


def test_file_names(spark):
    cases = {"a/b.tex@1-20": "a/b.tex", ".\\a\\.\\b//c.tex": "a/b/c.tex", "a/x/../b.tex": "a/b.tex", "../a": "../a", "/../a/": "/a", "a/../../b": "../b", "": "", None: None, "A/b@c.tex": "A/b@c.tex"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", file_name(F.col("p")).alias("n"), file_source(F.col("p")).alias("s"))
    got = {r.p: r.n for r in df.collect()}
    assert got == cases


def test_labels_and_references(spark):
    d = docs(spark, r"\ref{a}\label{a}\label{b}\label{b}\eqref{c}", r"\label{a}", None, "")
    assert {(r.doc_id, r.key) for r in st.undefined_references(d).collect()} == {(0, "c")}
    assert {(r.key, r.n) for r in st.duplicate_labels(d).collect()} == {("b", 2)}
    assert {r.key for r in st.forward_references(d).collect()} == {"a"}
    assert {(r.key, r.n_docs) for r in st.shared_labels(d).collect()} == {("a", 2)}


def test_structure(spark):
    d = docs(spark, r"\section{A}\subsubsection{x}\begin{a}\begin{b}\end{b}\end{a}{", "One two. One three. Two.", None)
    assert [(r.level, r.skip) for r in st.headings(d).orderBy("pos").collect()] == [(1, False), (3, True)]
    assert st.environment_depth(d).first()["max_depth"] == 2
    assert {r.doc_id for r in st.brace_balance(d).collect()} == {0}
    assert [(r.doc_id, r.n) for r in st.repeated_openings(d).collect()] == [(1, 1)]
    kinds = {r.kind for r in st.tokens(d).collect()}
    assert {"command", "word", "open", "close", "space"} <= kinds


def test_rule_counts(spark):
    text = "a --- b... c!!! \"q\" x~~y 3.14 $\\sqrt{\\sqrt{x}} _{ab}$ % --\nend"
    got = {r.rule_id: r.n for r in findings(docs(spark, text, None, "")).collect()}
    assert got["TYPO-002"] == 2 and got["TYPO-003"] == 1  # overlapping, comments excluded
    assert got["TYPO-027"] == 2 and got["TYPO-001"] == 2 and got["SPC-028"] == 1 and got["MATH-086"] == 1
    assert "CHAR-014" not in got


def test_label_rules(spark):
    d = docs(spark, r"\ref{eq:x}\label{Fig A}\label{fig:b}\label{fig:b}\ref{eq:y}\label{eq:y}\label{eq:z}", "no", None)
    got = {r.rule_id: r.n for r in st.label_rules(d).collect()}
    assert got == {"REF-001": 1, "REF-002": 1, "REF-003": 1, "REF-004": 1, "REF-005": 1, "REF-009": 1, "MATH-023": 1, "MATH-024": 1, "FIG-012": 1}


SETUPS = {
    "PKG-002": ("\\usepackage{hyperref}\\usepackage[a]{b,geometry}\\begin{document}", "\\usepackage{geometry}\\usepackage{hyperref}\\begin{document}"),
    "PKG-011": ("\\usepackage{x}\\toprule", "\\usepackage{a, booktabs}\\toprule"), "DOC-002": ("\\documentclass[a]{article}", "\\documentclass{slides}"), "LANG-005": ("\\hyphenpenalty = 49 ", "\\hyphenpenalty=500"),
    "FIG-001": ("\\begin{figure*}x\\end{figure*}\\begin{figure}\\caption{a}\\end{figure}", "\\begin{figure}\\caption{a}\\end{figure}"), "FIG-003": ("\\begin{figure}\\centering\\label{a}\\caption{b}\\end{figure}", "\\begin{figure}\\caption{b}\\label{a}\\end{figure}"),
    "FIG-007": ("\\begin{figure}\\includegraphics[scale=0.5]{a}\\includegraphics[alt={t}]{b}\\end{figure}", "\\begin{figure}\\includegraphics[width=a,alt={t}]{b}\\end{figure}"), "TAB-002": ("\\begin{table}\\begin{tabular}{l}a\\end{tabular}\\caption{b}\\end{table}", "\\begin{table}\\caption{b}\\begin{tabular}{l}a\\end{tabular}\\end{table}"),
    "TAB-008": ("\\begin{tabular}" + "a\\\\" * 30 + "\\end{tabular}", "\\begin{tabular}" + "a\\\\" * 29 + "\\end{tabular}"), "TAB-011": ("\\begin{tabular}\\hline\\end{tabular}", "\\begin{tabular}\\hline\\toprule\\end{tabular}"), "MATH-062": ("\\begin{align}x\\end{align}", "\\begin{align}x&y\\end{align}"),
    "VERB-002": ("\\begin{verbatim}\ta\\end{verbatim}", "\ta\\begin{verbatim}a\\end{verbatim}"), "VERB-007": ("\\begin{minted}\\begin{verbatim}\\end{minted}", "\\begin{minted}a\\end{minted}"), "TIKZ-005": ("\\begin{tikzpicture}", "\\begin{tikzpicture}\\tikzexternalize"), "L3-005": ("\\tl_new:N", "\\ExplSyntaxOn\\tl_new:N"), "META-003": ("\\date{\\today}", "\\date{2020}"),
}


def test_setup_rules(spark):
    import duckdb

    from proofmill.plans.registry import sql_findings

    rows = [(2 * i + k, t) for i, pair in enumerate(SETUPS.values()) for k, t in enumerate(pair)]
    got = {(r.doc_id, r.rule_id): r.n for r in findings(spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id bigint, text string, lang string")).collect()}
    for i, rule in enumerate(SETUPS):
        assert got.get((2 * i, rule)) == 1 and (2 * i + 1, rule) not in got, rule
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, NULL)", rows)
    assert {(a, b): n for a, b, _, n in con.execute(sql_findings()).fetchall()} == got


def test_rule_ids_are_unique_and_literals_needed(spark):
    import re

    rules = all_rules()
    assert len({r.rule_id for r in rules}) == len(rules)
    assert required_literal("[^ \\n] {2,}[^ \\n]") in ("", " ")
    assert required_literal("a|b") == "" and required_literal("\\\\sum[ \\t]*_") == "\\sum"
    for r in rules:
        if r.kind == "re":
            assert re.search("[0-9]", required_literal(r.pattern)) is None or re.search("[0-9]", r.pattern)


def test_conflicts(spark):
    f = spark.createDataFrame([(1, "TYPO-002", "Warning", 4), (1, "TYPO-003", "Warning", 2), (1, "SPC-001", "Info", 1), (2, "TYPO-002", "Warning", 1)], "doc_id bigint, rule_id string, severity string, n bigint")
    assert {(r.doc_id, r.rule_id) for r in fo.resolve_conflicts(f).collect()} == {(1, "TYPO-003"), (1, "SPC-001"), (2, "TYPO-002")}


def test_waivers(spark):
    f = spark.createDataFrame([(1, "R-1", "a/b/c.tex"), (2, "R-1", "a/x.tex"), (3, "R-2", None)], "doc_id bigint, rule_id string, path string")
    w = fo.waiver_frame(spark, [(1, "R-1", "x.t?x"), (2, "R-1", "a/*")])
    assert {r.doc_id: r.waiver for r in fo.waive(f, w).collect()} == {1: 2, 2: 1, 3: None}


def test_dirty_chunks(spark):
    a, b = docs(spark, "x\n\ny", "p\n\nq", "same"), docs(spark, "x\n\nz", "p\n\nq\n\nr", "same")
    got = {(r.doc_id, r.chunk_no) for r in fo.dirty_chunks(fo.chunks(a), fo.chunks(b)).collect()}
    assert got == {(0, 1), (1, 0), (1, 1), (1, 2)}


def test_salted_join_equals_plain_join(spark):
    a = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    b = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("y"))
    got = salted_join(a, b, "k", F.col("x"), most=40)
    assert got.count() == a.join(b, "k").count() == got.distinct().count()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40) if i != 20] + [(50, 50), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(e, "a", "b").collect()}
    assert all(got[i] == (1 if i <= 20 else 21) for i in range(1, 41)) and 50 not in got
    assert connected_components(e.limit(0), "a", "b").count() == 0


def test_tag_spans(spark):
    rows = [(1, ["O", "B-x", "I-x", "B-x", "O", "I-y"], [(1, 3, "x"), (3, 4, "x"), (9, 12, "z")]), (2, None, None)]
    d = spark.createDataFrame(rows, "labeled_id bigint, bio_tags array<string>, spans array<struct<span_start:int,span_end:int,rule_id:string>>")
    assert {(r.rule_id, r.span_start, r.span_end) for r in fo.tag_spans(d).collect()} == {("x", 1, 3), ("x", 3, 4), ("y", 5, 6)}
    m = {r.rule_id: (r.tp, r.fp, r.fn) for r in fo.span_metrics(d).collect()}
    assert m == {"x": (2, 0, 0), "y": (0, 1, 0), "z": (0, 0, 1)}
