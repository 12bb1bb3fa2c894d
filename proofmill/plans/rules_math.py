"""Rules on mathematics, as rows like those of ``rules_text``."""

from proofmill.plans.rules_text import E, I, W

_SUB = "_(\\{[^}]*\\}|[A-Za-z0-9])"
_SUP = "\\^(\\{[^}]*\\}|[A-Za-z0-9])"

# Rule ids and severities, with the commands and sequences that each rule is about.
RULES = [
    ("CHEM-001", W, "math", "re", "[A-Z][a-z]?_(\\{[0-9]+\\}|[0-9])", (), "formula without chemistry markup"),
    ("CHEM-002", W, "math", "re", "[A-Z][a-z]?\\^[0-9][+-]", (), "oxidation state without braces"),
    ("CHEM-003", W, "math", "re", "_(\\{[0-9]+\\}|[0-9]+)[A-Z]", (), "mass number as a subscript"),
    ("CHEM-004", I, "math", "re", "[A-Z][a-z]?\\^[+-][^}]", (), "charge without braces"),
    ("CHEM-005", I, "math", "re", "->", (), "typed arrow"),
    ("CHEM-008", I, "math", "re", "\\((aq|s|l|g)\\)", (), "state symbol in italics"),
    ("CHEM-009", W, "math", "re", "<->|<=>", (), "typed equilibrium arrow"),
    ("DELIM-006", I, "nomath", "re", "\\\\[Bb]igg?[lrmg]?[^a-zA-Z]", (), "big delimiter outside display mathematics"),
    ("DELIM-008", I, "math", "re", "\\\\left\\.[ \\t\\n]*\\\\right\\.", (), "empty delimiter pair"),
    ("MATH-009", W, "math", "re", "(^|[^\\\\a-zA-Z])(sin|cos|tan|cot|log|exp|ln|lim|max|min)([^a-zA-Z]|$)", (), "function name without its command"),
    ("MATH-010", W, "math", "re", "\\x{F7}", (), "division sign"),
    ("MATH-011", I, "math", "all", ["\\\\vec\\{", "\\\\mathbf\\{"], (), "two notations for vectors"),
    ("MATH-014", I, "math", "re", "\\\\frac\\{", (), "fraction in a formula"),
    ("MATH-015", W, "math", "re", "\\\\stackrel\\{", (), "stackrel"),
    ("MATH-016", W, "math", "re", "_([A-Za-z0-9])_", (), "nested subscripts without braces"),
    ("MATH-018", I, "math", "re", "3\\.14[0-9]*", (), "pi as a number"),
    ("MATH-019", W, "math", "re", _SUP + _SUB, (), "superscript before subscript"),
    ("MATH-020", I, "math", "re", "[0-9](\\\\vec\\{|\\\\mathbf\\{)", (), "coefficient next to a vector"),
    ("MATH-021", I, "math", "re", "\\|[A-Za-z0-9]+\\|", (), "absolute value in plain bars"),
    ("MATH-022", I, "math", "re", "\\\\textbf\\{", (), "text bold in mathematics"),
    ("MATH-028", I, "raw", "re", "\\\\begin\\{array\\}[^{]", (), "array without column specification"),
    ("MATH-029", W, "raw", "re", "\\\\begin\\{eqnarray\\*?\\}", (), "eqnarray"),
    ("MATH-030", I, "math", "re", "\\\\displaystyle", (), "displaystyle"),
    ("MATH-031", I, "math", "re", "[A-Za-z0-9}]\\\\text\\{", (), "no space before text"),
    ("MATH-033", I, "nomath", "re", "\\\\pm", (), "plus-minus command in text"),
    ("MATH-035", W, "math", "re", _SUB + "_", (), "stacked subscripts"),
    ("MATH-036", I, "math", "re", "\\\\mathrm\\{[A-Za-z]\\}", (), "upright single letter"),
    ("MATH-037", I, "math", "re", "\\\\sfrac\\{", (), "slanted fraction"),
    ("MATH-040", I, "math", "re", "[+=<>-][ ]*\\\\ldots[ ]*[+=<>-]", (), "low ellipsis between operators"),
    ("MATH-041", I, "math", "re", "\\\\int_", (), "integral with limits"),
    ("MATH-042", I, "math", "re", "[0-9]\\\\(mathrm|text|textrm)\\{", (), "number next to a unit"),
    ("MATH-043", W, "math", "re", "\\\\text\\{[A-Z][a-z]+\\}", (), "text instead of an operator name"),
    ("MATH-044", W, "math", "re", "[^\\\\]<=|[^\\\\]>=", (), "typed relation"),
    ("MATH-046", I, "math", "re", ",[ ]*\\\\ldots[ ]*,", (), "ellipsis between commas"),
    ("MATH-047", E, "math", "re", _SUP + "\\^", (), "double superscript"),
    ("MATH-048", I, "math", "re", "\\\\mathbf\\{[0-9]+\\}", (), "bold digits"),
    ("MATH-049", I, "math", "re", "[A-Za-z0-9}]\\\\times|\\\\times[A-Za-z0-9{]", (), "no space at a product sign"),
    ("MATH-050", W, "math", "re", "\\\\hat\\{[A-Za-z][A-Za-z]+\\}", (), "hat over letters"),
    ("MATH-053", I, "math", "re", "\\\\left\\( ", (), "blank behind an opening delimiter"),
    ("MATH-054", W, "raw", "re", "\\\\label\\{eq:[^}]*\\}", (), "equation label"),
    ("MATH-055", I, "math", "re", "\\\\mathcal\\{[^}][^}]+\\}", (), "calligraphic letters in a row"),
    ("MATH-057", E, "math", "re", "\\\\frac(\\{[ ]*\\}|\\{[^{}]*\\}\\{[ ]*\\})", (), "empty part of a fraction"),
    ("MATH-058", I, "math", "re", "\\\\text\\{[^}]*\\\\text\\{", (), "text within text"),
    ("MATH-059", W, "math", "re", "\\\\bar\\{[^}]*[ +=-][^}]*\\}", (), "bar over an expression"),
    ("MATH-061", W, "math", "re", "\\\\log_[0-9][0-9a-zA-Z]", (), "logarithm base without braces"),
    ("MATH-064", W, "raw", "re", "\\\\eqalign", (), "eqalign"),
    ("MATH-065", I, "math", "re", "\\\\hspace", (), "manual space"),
    ("MATH-066", I, "math", "re", "\\\\phantom\\{", (), "phantom"),
    ("MATH-067", W, "math", "re", "\\\\limits", (), "forced limits"),
    ("MATH-068", I, "math", "re", "[^ \\t\\n]\\\\mid|\\\\mid[^ \\t\\n]", (), "no space at a bar"),
    ("MATH-069", I, "math", "re", "\\\\mathbfsf|\\\\bm\\{\\\\mathsf\\{", (), "bold sans serif"),
    ("MATH-070", I, "math", "re", "_\\{[^}]*\\\\\\\\[^}]*\\}", (), "line break in a subscript"),
    ("MATH-071", I, "math", "re", "\\\\cancel\\{", (), "cancelled term"),
    ("MATH-072", W, "math", "re", "\\\\operatorname\\{(sin|cos|tan|log|exp|ln|lim|max|min|det|gcd|dim|ker)\\}", (), "known operator spelled out"),
    ("MATH-073", W, "math", "re", "\\\\color\\{", (), "colour in mathematics"),
    ("MATH-078", I, "math", "re", "-->", (), "typed long arrow"),
    ("MATH-081", I, "math", "re", "[a-zA-Z]\\([^)]*\\)", (), "function argument"),
    ("MATH-082", W, "math", "re", "\\\\!\\\\!", (), "negative spaces in a row"),
    ("MATH-083", W, "nomath", "re", "\\x{2212}", (), "minus character in text"),
    ("MATH-084", I, "math", "re", "\\\\displaystyle[ ]*\\\\sum", (), "display sum"),
    ("MATH-085", I, "math", "re", "\\\\eqcirc", (), "eqcirc"),
    ("MATH-086", W, "math", "re", "\\\\sqrt\\{\\\\sqrt\\{", (), "nested root"),
    ("MATH-087", I, "math", "re", "\\\\mathbf\\{[0-9]+\\}", (), "fake bold digits"),
    ("MATH-090", W, "math", "re", "\\\\frac\\{\\\\frac\\{\\\\frac\\{", (), "fractions four deep"),
    ("MATH-091", I, "math", "re", "\\\\operatorname\\{det\\}", (), "determinant spelled out"),
    ("MATH-092", I, "math", "re", "\\\\sum[ \\t]*_", (), "sum with limits"),
    ("MATH-094", I, "math", "re", "\\\\kern", (), "manual kern"),
    ("MATH-095", W, "math", "re", "\\\\log_[0-9][0-9a-zA-Z]", (), "logarithm base without braces"),
    ("MATH-096", I, "math", "re", "\\\\mathbf\\{\\\\[A-Za-z]+\\}", (), "bold Greek by mathbf"),
    ("MATH-097", I, "math", "re", "[^=!<>\\\\]=>", (), "typed implication"),
    ("MATH-099", I, "math", "re", "\\\\big(cup|cap|oplus|otimes|sqcup|vee|wedge)[^a-zA-Z]", (), "large operator"),
    ("MATH-101", W, "math", "re", "\\\\over[^a-zA-Z]", (), "over primitive"),
    ("MATH-102", W, "raw", "re", "\\\\begin\\{eqnarray\\}", (), "eqnarray"),
    ("MATH-106", I, "math", "re", "\\\\not=", (), "negated equality"),
    ("MATH-107", I, "raw", "all", ["\\\\le[^a-zA-Z]", "\\\\leqslant"], (), "two less-or-equal signs"),
    ("MATH-108", I, "math", "re", "\\x{B7}", (), "middle dot"),
    ("SCRIPT-001", W, "math", "re", "_[A-Za-z0-9][A-Za-z0-9]+", (), "subscript of several characters without braces"),
    ("SCRIPT-003", W, "math", "re", "\\^[A-Za-z0-9],[A-Za-z0-9,]+", (), "list of superscripts without braces"),
    ("SCRIPT-004", I, "math", "re", "'+_", (), "subscript behind a prime"),
    ("SCRIPT-005", I, "math", "re", "\\^(l|\\{l\\})", (), "letter l as a superscript"),
    ("SCRIPT-006", I, "math", "re", "\\x{B0}", (), "degree sign in mathematics"),
    ("SCRIPT-007", W, "math", "re", "_\\{[A-Za-z]{3,}\\}", (), "word as a subscript"),
    ("SCRIPT-008", I, "math", "re", "[A-Z][a-z]?_[0-9]+", (), "formula in italics"),
    ("SCRIPT-009", I, "math", "re", "\\^\\{[ ]*\\}_\\{", (), "empty mass number"),
    ("SCRIPT-010", I, "math", "re", "\\\\limits", (), "limits on an inline operator"),
    ("SCRIPT-012", I, "math", "needle", ("'", 4), (), "more than three primes"),
    ("SCRIPT-013", I, "math", "re", "_\\{[+-]\\}", (), "sign as a subscript"),
    ("SCRIPT-014", I, "math", "re", "\\\\log_[A-Za-z]", (), "letter as a logarithm base"),
    ("SCRIPT-017", I, "math", "all", [_SUB + _SUP, _SUP + _SUB], (), "two orders of scripts"),
    ("SCRIPT-018", W, "math", "re", "\\^\\\\circ", (), "degree without braces"),
    ("SCRIPT-019", I, "math", "needle", ("'", 2), (), "double prime"),
    ("SCRIPT-020", I, "math", "re", "_\\{[a-z][a-z]+\\}", (), "word as a subscript in italics"),
    ("SCRIPT-021", W, "math", "re", _SUP + _SUB, (), "superscript before subscript"),
    ("SCRIPT-022", I, "math", "re", "\\^\\{''''", (), "more than three primes in a superscript"),
]
