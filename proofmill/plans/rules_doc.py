"""Rules on commands, references, floats, packages, bibliography, code, languages and style, as rows like those of ``rules_text``."""

from proofmill.plans.rules_text import E, I, W

_DEF = "\\\\(re|provide)?newcommand\\*?[ \\t\\n]*\\{?\\\\"
_OPT = "\\\\usepackage\\[[^\\]]*"

# Rule ids and severities, with the commands, fields and words that each rule is about.
RULES = [
    ("BIB-002", I, "raw", "re", "doi[ \\t]*=[ \\t]*\\{10\\.", (), "DOI without its resolver"),
    ("BIB-006", I, "raw", "re", "author[ \\t]*=[ \\t]*\\{[A-Z][a-z]+ [A-Z]", (), "author not as last name, first name"),
    ("BIB-010", I, "raw", "re", "month[ \\t]*=[ \\t]*[{0-9\"]", (), "month not as a macro"),
    ("BIB-011", I, "raw", "re", "note[ \\t]*=[ \\t]*\\{(URL:|http)", (), "URL in a note"),
    ("BIB-012", W, "raw", "re", "author[ \\t]*=[ \\t]*\\{[^}]*et al\\.", (), "et al. in an author list"),
    ("BIB-015", I, "raw", "re", "(title|note)[ \\t]*=[ \\t]*\\{[^}]*\\.\\}", (), "period at a field's end"),
    ("BIB-017", I, "raw", "re", "title *= *\\{[^}]*[.!?;:]\\}", (), "title ends in punctuation"),
    ("CE-001", I, "prose", "all", ["colour|favour", "color[^a-z]|favor[^a-z]"], ("en",), "two spellings"),
    ("CE-002", I, "prose", "re", "[a-zA-Z]+, [a-zA-Z]+ and [a-zA-Z]", ("en",), "list without its last comma"),
    ("CJK-001", W, "nomath", "re", "[A-Za-z0-9]\\x{FF0C}", ("zh", "ja", "ko"), "full-width comma behind ASCII"),
    ("CJK-002", W, "nomath", "re", "[A-Za-z0-9]\\x{FF0E}", ("zh", "ja", "ko"), "full-width period behind ASCII"),
    ("CJK-008", W, "math", "re", "\\x{3000}", ("zh", "ja", "ko"), "full-width blank in mathematics"),
    ("CJK-009", I, "raw", "re", "[\\x{4E00}-\\x{9FFF}] [\\x{4E00}-\\x{9FFF}]", (), "blank between ideographs"),
    ("CJK-010", W, "nomath", "re", "[\\x{4E00}-\\x{9FFF}][,.:;]", ("zh", "ja", "ko"), "half-width punctuation behind an ideograph"),
    ("CJK-011", I, "raw", "re", "\\n\\x{30FC}", (), "prolonged-sound mark at a line's start"),
    ("CJK-013", I, "raw", "re", "\\n\\x{3002}", (), "full stop at a line's start"),
    ("CJK-014", I, "nomath", "re", "[A-Za-z0-9]\\x{30FB}|\\x{30FB}[A-Za-z0-9]", ("zh", "ja", "ko"), "middle dot beside ASCII"),
    ("CJK-015", W, "math", "re", "\\x{3001}", ("zh", "ja", "ko"), "ideographic comma in mathematics"),
    ("CMD-002", W, "raw", "re", "\\\\def\\\\[a-zA-Z]+", (), "plain definition"),
    ("CMD-004", I, "raw", "re", _DEF + "[a-z]+[A-Z][a-zA-Z]*", (), "camel-case command"),
    ("CMD-005", W, "raw", "re", _DEF + "[a-zA-Z]\\}", (), "command of one letter"),
    ("CMD-006", I, "body", "re", _DEF, (), "definition in the body"),
    ("CMD-009", I, "raw", "re", _DEF + "[a-zA-Z]*[0-9]", (), "digit in a command's name"),
    ("CMD-013", I, "body", "re", "\\\\def\\\\arraystretch", (), "row height set in the body"),
    ("CS-001", I, "raw", "re", "\\\\,\\x{B0}C|\\x{A0}\\x{B0}C", ("cs",), "thin space before a degree unit"),
    ("FIG-005", W, "raw", "re", "\\\\includegraphics\\[[^\\]]*width *= *([2-9]|1\\.[0-9]*[1-9])[0-9.]*\\\\(line|text)width", (), "figure wider than the line"),
    ("FIG-008", W, "raw", "re", "\\\\(usepackage|documentclass)\\[draft\\]|draft=true", (), "draft mode"),
    ("FIG-013", I, "raw", "re", "\\\\includegraphics\\[[^\\]]*scale[ ]*=[^\\]]*\\]", (), "scaled graphic"),
    ("FIG-024", I, "raw", "re", "\\\\includegraphics\\[[^\\]]*alt=\\{[^}]{141,}\\}", (), "long alternative text"),
    ("FONT-004", I, "math", "re", "\\\\text(it|bf|rm|sf|tt)\\{", (), "text font in mathematics"),
    ("FONT-010", I, "raw", "re", "\\\\textsc\\{[^}]*[0-9][^}]*\\}", (), "digits in small capitals"),
    ("FR-007", I, "raw", "re", " \\x{20AC}|\\x{20AC} ", ("fr",), "plain blank at a currency sign"),
    ("FR-008", W, "raw", "re", "[Cc]oeur|[Oo]euvre|[Oo]euf|[Oo]eil", ("fr",), "missing ligature"),
    ("JA-002", I, "raw", "re", "\\x{FF5E}", ("ja",), "full-width tilde"),
    ("LANG-002", W, "raw", "re", "\\\\usepackage(\\[\\])?\\{babel\\}", (), "babel without a language"),
    ("LANG-009", I, "raw", "all", ["\\\\raggedright", "\\\\begin\\{CJK\\}|xeCJK"], (), "ragged text in another script"),
    ("LANG-014", I, "prose", "all", ["[a-z]ize[ds .,\\n]", "[a-z]ise[ds .,\\n]"], ("en",), "two verb endings"),
    ("LANG-015", I, "prose", "re", "[a-zA-Z]+, [a-zA-Z]+ and [a-zA-Z]", ("en",), "serial comma"),
    ("LANG-016", I, "prose", "all", ["programme", "program[ ,.]"], ("en",), "two spellings of a word"),
    ("NL-002", I, "raw", "all", ["\\x{2018}", "\\x{201E}"], ("nl",), "two kinds of quotation marks"),
    ("PKG-003", E, "raw", "all", ["microtype", "luatexja|lualatex|LuaLaTeX"], (), "options that exclude each other"),
    ("PKG-004", E, "body", "re", "\\\\usepackage", (), "package loaded in the body"),
    ("PKG-006", I, "raw", "all", ["microtype", "expansion=false"], (), "expansion switched off"),
    ("PKG-009", I, "body", "re", "\\\\usetikzlibrary", (), "library loaded in the body"),
    ("PKG-018", I, "raw", "re", _OPT + "draft[^\\]]*\\]\\{hyperref\\}", (), "hyperref in draft mode"),
    ("PL-001", I, "raw", "re", " (r\\.|nr |s\\.)", ("pl",), "plain blank before an abbreviation"),
    ("PL-002", I, "raw", "all", ["\\x{AB}", "\\x{201E}"], ("pl",), "two kinds of quotation marks"),
    ("PT-001", W, "raw", "re", "ac\\x{E7}\\x{E3}o|\\x{F3}ptimo|direc\\x{E7}\\x{E3}o", ("pt",), "old spelling"),
    ("PT-002", I, "math", "re", "[0-9]+\\.[0-9]+", ("pt",), "decimal point"),
    ("PT-003", I, "raw", "re", "[0-9]\\\\textsuperscript\\{[oa]\\}", ("pt",), "ordinal as a superscript"),
    ("REF-006", I, "prose", "re", "[Pp]age[ ~]*\\\\ref\\{", (), "page reference by ref"),
    ("REF-007", E, "prose", "re", "\\\\cite[^{]*\\{[^}]*[ \\t][^}]*\\}", (), "blank in a citation key"),
    ("REF-011", E, "raw", "re", "\\\\autoref", (), "autoref"),
    ("REF-012", I, "nomath", "re", "(above|below)[ ,]*\\\\ref\\{|\\\\ref\\{[^}]*\\}[ ,]*(above|below)", (), "position named beside a reference"),
    ("RO-001", W, "raw", "re", "[\\x{015E}\\x{015F}\\x{0162}\\x{0163}]", ("ro",), "cedilla instead of comma"),
    ("RU-001", I, "raw", "re", " \\x{2014}", ("ru",), "plain blank before a dash"),
    ("RU-002", I, "raw", "re", "\\x{0435}\\x{0449}\\x{0435}|\\x{0432}\\x{0441}\\x{0435}", ("ru",), "missing dots on a letter"),
    ("STYLE-001", I, "prose", "all", [", [a-zA-Z]+, and", ", [a-zA-Z]+ and"], (), "two uses of the serial comma"),
    ("STYLE-002", I, "prose", "all", ["colour|favour", "color[^a-z]|favor[^a-z]"], (), "two spellings"),
    ("STYLE-005", I, "prose", "all", ["[Ww]e ", " I [a-z]| I,| I\\."], (), "two pronouns"),
    ("STYLE-008", I, "nocomment", "re", "\\. \\$", (), "sentence begins with a formula"),
    ("STYLE-009", I, "nocomment", "all", ["\\\\cite\\{|\\\\citep\\{|\\\\parencite\\{", "\\\\citet\\{|\\\\textcite\\{"], (), "two citation styles"),
    ("STYLE-011", I, "prose", "all", ["[0-9]-[0-9]", "[0-9]--[0-9]"], (), "two dashes in ranges"),
    ("STYLE-012", I, "prose", "all", [", which [a-z]", "that [a-z]"], (), "relative clauses of two kinds"),
    ("STYLE-013", I, "prose", "re", "\\. +[0-9]", (), "sentence begins with a number"),
    ("STYLE-014", I, "prose", "re", "[a-z]n't|[Ii]t's|[Ww]e're", (), "contraction"),
    ("STYLE-016", I, "prose", "re", "e\\.g\\.[^,]|i\\.e\\.[^,]", (), "abbreviation without a comma"),
    ("STYLE-018", I, "prose", "re", "[Tt]his (is|was|has|shows|suggests|means)[^a-z]", (), "dangling this"),
    ("STYLE-019", I, "nocomment", "re", "section\\*?\\{[^}]*\\}\\s*\\\\(sub)*section", (), "headings in a row"),
    ("STYLE-022", I, "prose", "re", "[a-zA-Z]+, [a-zA-Z]+ and [a-zA-Z]", (), "list without its last comma"),
    ("STYLE-028", I, "nocomment", "re", "\\\\eqref\\{[^}]*\\} [A-Za-z]", (), "equation reference without punctuation"),
    ("STYLE-029", I, "prose", "re", "[Ww]e (present|propose|show)", (), "undefined we"),
    ("STYLE-031", W, "raw", "re", "\\\\(sub)*section\\*?\\{[0-9. ]*\\}", (), "heading without words"),
    ("STYLE-033", I, "raw", "re", " \\\\cite[^a-zA-Z]", (), "blank before a citation"),
    ("STYLE-035", I, "prose", "re", "and/or", (), "and/or"),
    ("STYLE-036", I, "prose", "re", "cf\\.|ibid\\.|et al\\.|viz\\.", (), "Latin phrase"),
    ("STYLE-037", I, "prose", "re", "\\. +(And|But) +", (), "sentence begins with a conjunction"),
    ("STYLE-040", I, "prose", "re", "!", (), "exclamation mark"),
    ("STYLE-044", I, "prose", "re", "[Tt]his (can|will|may|might|could|should)[^a-z]", (), "this without a noun"),
    ("STYLE-048", I, "prose", "all", ["among[^s]|while[^a-z]", "amongst|whilst"], (), "two variants of a word"),
    ("TAB-005", I, "raw", "re", "\\\\begin\\{tabular\\*?\\}\\{[^}]*\\|", (), "vertical rule"),
    ("TAB-006", I, "raw", "re", "\\\\hline[ \\t\\n]*\\\\hline", (), "doubled rule"),
    ("TAB-014", I, "raw", "re", "\\\\multicolumn\\{[^}]*\\}\\{\\}", (), "empty column specification"),
    ("TR-001", W, "raw", "re", "[\\x{0130}\\x{0131}]", ("tr",), "dotted or dotless i"),
    ("VERB-008", I, "raw", "re", "\\\\begin\\{lstlisting\\}\\[[^\\]]*language *= *none[^\\]]*\\]", (), "listing without a language"),
    ("VERB-010", I, "prose", "re", "`[^`\\n]+`", (), "code in back-ticks"),
    ("VERB-015", W, "raw", "re", "\\\\catcode[ \\t\\n]*`", (), "category code changed"),
    ("ZH-002", I, "raw", "all", ["\\x{300C}", "\\x{201C}"], ("zh",), "two kinds of quotation marks"),
]
