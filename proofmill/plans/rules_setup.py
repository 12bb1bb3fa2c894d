"""Rules on packages, classes and blocks, as rows like those of ``rules_text``.

Further kinds: ``but`` fires once if all patterns of the first list match and none of the second; ``block`` counts the
blocks of one of the environments whose bodies match all of the first list and none of the second (a pattern with a
number must match that often), and ``in_block``
counts matches of a pattern in their bodies. Blocks end at the first end of their name.
"""

E, W, I = "Error", "Warning", "Info"


def _pkg(name: str, options: str = "") -> str:
    """A package being loaded, alone or in a list, with options that hold a text."""
    opts = rf"\[[^\]]*{options}[^\]]*\]" if options else r"(\[[^\]]*\])?"
    return rf"\\usepackage{opts}\{{([^}}]*,)?[ ]*{name}[ ]*(,[^}}]*)?\}}"


def _after(later: str, earlier: str) -> str:
    return f"(?s){_pkg(earlier)}.*{_pkg(later)}"


# Rule ids and severities, with the packages, classes, commands and environments each is about.
_ARTICLE = r"\\documentclass(\[[^\]]*\])?\{(article|report|scrartcl|scrreprt|scrbook|amsart|IEEEtran|llncs|acmart|revtex4-2|elsarticle|svjour3|memoir|book)\}"
_XE = f"{_pkg('fontspec')}|{_pkg('xeCJK')}|{_pkg('ifxetex')}|{_pkg('ifluatex')}|{_pkg('luatexja')}"
_CAPTION = r"\\caption(\[|\{)"
_CODE = ("verbatim", "lstlisting", "minted")
_ALIGN = ("align", r"align\*", "flalign", r"flalign\*")
_FIGURE, _TABLE, _TABULAR = ("figure", r"figure\*"), ("table", r"table\*"), ("tabular", r"tabular\*")
_EQUATION = ("equation", r"equation\*", "align", r"align\*", "gather", r"gather\*")
_EXPL = r"\\[a-z]+_[a-z_]+:[nNoVvxfeTFpw]+"

RULES = [
    ("CHEM-010", I, "raw", "in_block", (("reaction", "scheme"), r"[^\n]{121,}"), (), "reaction scheme with long lines"),
    ("CJK-004", W, "raw", "but", ([r"[\x{3400}-\x{9FFF}]"], [_pkg("xeCJK"), _pkg("CJKutf8"), _pkg("ctex")]), ("zh", "ja", "ko"), "ideographs without their package"),
    ("CJK-005", I, "raw", "all", [r"\\setCJKmainfont", r"\\setjamainfont|\\setCJKfamilyfont\{min\}"], (), "fonts of two languages"),
    ("CJK-012", I, "raw", "but", ([r"\\usepackage\{xeCJK\}"], [r"\\xeCJKsetup"]), (), "spacing of ideographs not set up"),
    ("CJK-016", I, "raw", "but", ([r"\\xeCJKsetup"], ["CJKecglue"]), (), "glue of ideographs not set up"),
    ("CMD-012", W, "preamble", "all", [rf"(?s){_pkg('hyperref')}.*\\renewcommand\{{\\thesection\}}"], (), "section number redefined after hyperref"),
    ("COL-006", W, "preamble", "all", [_pkg("xcolor", "dvipsnames"), f"{_pkg('fontenc', 'T1')}|{_pkg('inputenc')}"], (), "named colours in the wrong engine"),
    ("DOC-001", E, "raw", "but", ([_ARTICLE], [r"\\maketitle"]), (), "title missing"),
    ("DOC-002", W, "raw", "but", ([_ARTICLE], [r"\\begin\{abstract\}"]), (), "abstract missing"),
    ("DOC-003", I, "raw", "but", ([_ARTICLE], [r"\\keywords\{"]), (), "keywords missing"),
    ("FIG-001", W, "raw", "block", (_FIGURE, [], [r"\\caption"]), (), "figure without caption"),
    ("FIG-002", W, "raw", "block", (_FIGURE, [], [r"\\label\{"]), (), "figure without label"),
    ("FIG-003", I, "raw", "block", (_FIGURE, [rf"(?s)\\label\{{.*{_CAPTION}"], [rf"(?s){_CAPTION}.*\\label\{{"]), (), "label before caption"),
    ("FIG-007", I, "raw", "in_block", (_FIGURE, r"\\includegraphics(\[([^\]a]|a[^\]l]|al[^\]t]){0,500}a?\])?\{"), (), "picture without alternative text"),
    ("FIG-009", I, "raw", "re", r"\\begin\{(figure|table)\*?\}\[[^\]]*![^\]]*\]", (), "forced placement"),
    ("FIG-010", W, "raw", "block", (("subfigure",), [], [r"\\subcaption|\\caption"]), (), "part of a figure without caption"),
    ("FIG-011", W, "raw", "but", ([r"\.eps[}\]]"], ["xelatex|lualatex"]), (), "encapsulated picture"),
    ("FIG-014", I, "raw", "block", (_FIGURE, [r"\\caption\{[^}]{301,}"], []), (), "caption too long"),
    ("FIG-019", I, "raw", "block", (("subfigure",), [], [r"\\subcaption", r"\\caption"]), (), "part of a figure without a letter"),
    ("FONT-003", W, "raw", "all", [r"\\usepackage", "microtype", "protrusion=false"], (), "protrusion switched off"),
    ("FONT-005", I, "raw", "but", ([r"\\usepackage\{fontspec\}"], [r"\\setmainfont"]), (), "fallback font"),
    ("FONT-006", I, "raw", "but", ([_pkg("microtype")], [r"\\microtypesetup\{[^}]*expansion[ ]*=[ ]*true[^}]*\}"]), (), "expansion not set up"),
    ("FONT-007", W, "raw", "all", [r"\\usepackage\[T1\]\{fontenc\}", f"{_pkg('fontspec')}|{_pkg('xeCJK')}|{_pkg('ifxetex')}"], (), "old font encoding"),
    ("FONT-011", W, "raw", "all", ["microtype", r"\\setmathfont|unicode-math"], (), "protrusion of text and mathematics"),
    ("FONT-013", W, "raw", "all", [r"\\begin\{tabular", r"\\proportional", r"\\tabularfigures"], (), "figures of two kinds in a table"),
    ("L3-005", E, "raw", "but", ([_EXPL], [r"\\ExplSyntaxOn"]), (), "programming layer not switched on"),
    ("LANG-004", E, "raw", "all", [_pkg("polyglossia"), _pkg("babel")], (), "two language packages"),
    ("LANG-005", I, "raw", "all", [r"\\hyphenpenalty *= *([0-9]|[1-4][0-9])([^0-9]|$)"], (), "low hyphen penalty"),
    ("LAY-008", I, "raw", "all", [r"\\documentclass\{(book|report)\}", r"\\raggedright", r"\\section"], (), "heading set left"),
    ("LAY-010", I, "raw", "all", [r"\\thispagestyle\{empty\}", r"\\chapter"], (), "no page number at a chapter"),
    ("LAY-012", I, "raw", "but", ([r"openright|\\documentclass\{book\}", r"\\chapter"], [r"\\cleardoublepage"]), (), "chapter may begin on a left page"),
    ("LAY-016", I, "raw", "block", (("longtable",), [], [r"\\allowbreak"]), (), "long table without break hints"),
    ("MATH-062", W, "raw", "block", (_ALIGN, [], ["&"]), (), "alignment without a mark"),
    ("META-001", I, "raw", "but", ([r"\\usepackage(\[[^\]]*\])?\{hyperref\}"], ["pdfproducer="]), (), "producer not set"),
    ("META-003", W, "raw", "all", [r"\\date\{\\today\}"], (), "date of the build"),
    ("META-004", I, "raw", "all", [r"\\pdfinfo"], (), "creation date of the file"),
    ("PDF-005", W, "raw", "but", ([r"\\usepackage", "hyperref"], [r"pdfa|pdfuatag|\\DocumentMetadata"]), (), "no conformance flag"),
    ("PKG-002", E, "preamble", "all", [_after("geometry", "hyperref")], (), "geometry after hyperref"),
    ("PKG-007", E, "preamble", "all", [_after("geometry", "hyperref")], (), "hyperref before geometry"),
    ("PKG-008", I, "preamble", "but", ([_pkg("xcolor")], [_pkg("xcolor", "dvipsnames")]), (), "colour names not loaded"),
    ("PKG-010", W, "preamble", "all", [_pkg("biblatex", "backend=biber")], (), "backend stated"),
    ("PKG-011", W, "raw", "but", ([r"\\toprule|\\midrule|\\bottomrule"], [_pkg("booktabs")]), (), "rules without their package"),
    ("PKG-012", E, "raw", "but", ([r"\\enquote\{"], [_pkg("csquotes")]), (), "quotation command without its package"),
    ("PKG-013", W, "raw", "but", ([_pkg("fontspec")], [_pkg("microtype")]), (), "microtype not loaded"),
    ("PKG-015", W, "raw", "all", [_pkg("inputenc"), _XE], (), "input encoding in a Unicode engine"),
    ("PKG-017", E, "preamble", "all", [_pkg("fontspec"), f"{_pkg('fontenc', 'T1')}|{_pkg('inputenc', 'utf8')}"], (), "fontspec in the wrong engine"),
    ("PKG-020", I, "raw", "but", ([r"\\tikzexternalize"], [r"\\usetikzlibrary\{external\}"]), (), "externalisation without its library"),
    ("PKG-023", E, "preamble", "all", [_after("unicode-math", "microtype")], (), "unicode-math after microtype"),
    ("PKG-025", W, "preamble", "all", [_pkg("fontspec"), _pkg("fontenc", "T1"), _pkg("inputenc")], (), "options of two engines"),
    ("TAB-001", W, "raw", "block", (_TABLE, [], [r"\\caption"]), (), "table without caption"),
    ("TAB-002", I, "raw", "block", (_TABLE, [rf"(?s)\\end\{{tabular\*?\}}.*{_CAPTION}"], [rf"(?s){_CAPTION}.*\\end\{{tabular\*?\}}"]), (), "caption below the table"),
    ("TAB-008", I, "raw", "block", (_TABULAR, [(r"\\\\", 30)], []), (), "table of more than 30 rows"),
    ("TAB-009", W, "raw", "block", (_TABLE, [], [r"\\label\{"]), (), "table without label"),
    ("TAB-010", W, "raw", "block", (_TABLE, [r"\\footnote\{"], []), (), "footnote in a table"),
    ("TAB-011", I, "raw", "block", (_TABULAR, [r"\\hline"], [r"\\toprule|\\bottomrule"]), (), "plain rules"),
    ("TAB-015", W, "raw", "block", (("tabularx",), [r"\\multirow"], [r"\\raggedright"]), (), "rows joined in a justified column"),
    ("TIKZ-005", I, "raw", "but", ([r"\\begin\{tikzpicture\}"], [r"\\usetikzlibrary\{external\}|\\tikzexternalize"]), (), "drawings not externalised"),
    ("TIKZ-006", W, "raw", "block", (_FIGURE, [r"\\begin\{tikzpicture\}"], [r"\\caption"]), (), "drawing without caption"),
    ("TIKZ-007", W, "preamble", "all", [_after("tikz", "hyperref")], (), "TikZ after hyperref"),
    ("VERB-002", I, "raw", "in_block", (_CODE, r"\t"), (), "tab in code"),
    ("VERB-003", I, "raw", "in_block", (_CODE, r"[ \t]+\n"), (), "trailing blank in code"),
    ("VERB-004", W, "raw", "in_block", (_CODE, r"[\x{2018}\x{2019}\x{201C}\x{201D}]"), (), "curly quotation mark in code"),
    ("VERB-007", E, "raw", "in_block", (_CODE, r"\\begin\{(verbatim|lstlisting|minted)\}"), (), "code within code"),
]
