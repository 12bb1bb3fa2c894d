"""Rules on characters, spacing and typography, as rows: id, severity, scope, kind, pattern, languages, message.

Kinds: ``re`` counts non-overlapping matches; ``needle`` counts overlapping occurrences of one repeated character
(given as character and length); ``all`` fires once if every pattern of the list matches; ``line_bytes`` counts
lines of more bytes than given. Patterns use only what Java's engine and RE2 have in common.
"""

E, W, I = "Error", "Warning", "Info"

# Rule ids and severities, with the characters and sequences that each rule is about.
RULES = [
    ("CHAR-005", E, "raw", "re", "[\\x{00}-\\x{06}\\x{0B}\\x{0E}-\\x{1F}]", (), "control character"),
    ("CHAR-006", E, "raw", "re", "\\x{08}", (), "backspace character"),
    ("CHAR-007", E, "raw", "re", "\\x{07}", (), "bell character"),
    ("CHAR-008", W, "raw", "re", "\\x{0C}", (), "form feed"),
    ("CHAR-009", W, "raw", "re", "\\x{7F}", (), "delete character"),
    ("CHAR-010", I, "raw", "re", "\\x{200F}", (), "right-to-left mark"),
    ("CHAR-011", I, "raw", "re", "\\x{200E}", (), "left-to-right mark"),
    ("CHAR-012", I, "raw", "re", "\\x{200D}", (), "zero-width joiner"),
    ("CHAR-013", W, "raw", "re", "[\\x{2066}-\\x{2069}]", (), "bidirectional isolate"),
    ("CHAR-014", W, "raw", "re", "\\x{FFFD}", (), "replacement character"),
    ("CHAR-015", I, "raw", "re", "[\\x{1F300}-\\x{1F9FF}]", (), "emoji"),
    ("CHAR-016", W, "nomath", "re", "[A-Za-z0-9][\\x{3001}\\x{3002}\\x{FF0C}\\x{FF0E}]", (), "wide punctuation after ASCII"),
    ("CHAR-017", W, "raw", "re", "[\\x{FF21}-\\x{FF3A}\\x{FF41}-\\x{FF5A}]", (), "full-width Latin letter"),
    ("CHAR-018", I, "raw", "re", "[\\x{FB00}-\\x{FB04}]", (), "ligature character"),
    ("CHAR-019", I, "nomath", "re", "\\x{2212}", (), "Unicode minus in text"),
    ("CHAR-020", I, "raw", "re", "[A-Z]\\x{DF}|\\x{DF}[A-Z]", (), "sharp s beside a capital"),
    ("CHAR-021", E, "raw", "re", "[^\\x{FEFF}]\\x{FEFF}", (), "zero-width no-break space inside the text"),
    ("CHAR-022", W, "raw", "re", "[\\x{E0000}-\\x{E007F}]", (), "tag character"),
    ("CHAR-004", I, "raw", "re", "[\\x{E000}-\\x{F8FF}]", (), "private-use character"),
    ("ENC-002", E, "raw", "re", "[^\\x{FEFF}]\\x{FEFF}", (), "byte order mark inside the text"),
    ("ENC-007", W, "raw", "re", "\\x{200B}", (), "zero-width space"),
    ("ENC-008", W, "raw", "re", "[\\x{E000}-\\x{F8FF}]", (), "private-use code point"),
    ("ENC-012", E, "raw", "re", "[\\x{80}-\\x{9F}]", (), "C1 control character"),
    ("ENC-013", I, "raw", "all", ["\\r\\n", "[^\\r]\\n"], (), "mixed line endings"),
    ("ENC-015", W, "raw", "re", "[\\x{B5}\\x{2126}\\x{212B}\\x{017F}]", (), "compatibility look-alike"),
    ("ENC-016", W, "raw", "re", "[\\x{FF10}-\\x{FF19}]", (), "full-width digit"),
    ("ENC-017", W, "raw", "re", "\\x{AD}", (), "soft hyphen"),
    ("ENC-019", W, "raw", "re", "\\x{0300}{2,}|\\x{0301}{2,}|\\x{0308}{2,}", (), "doubled combining accent"),
    ("ENC-020", W, "raw", "re", "[\\x{200E}\\x{200F}]", (), "invisible direction mark"),
    ("ENC-021", W, "raw", "re", "\\x{2060}", (), "word joiner"),
    ("ENC-022", W, "raw", "re", "[\\x{FFF9}-\\x{FFFB}]", (), "interlinear annotation character"),
    ("ENC-023", W, "raw", "re", "\\x{202F}", (), "narrow no-break space"),
    ("ENC-024", W, "raw", "re", "[\\x{202A}-\\x{202E}]", (), "bidirectional embedding"),
    ("SPC-001", I, "raw", "line_bytes", 120, (), "line of more than 120 bytes"),
    ("SPC-002", I, "raw", "re", "\\n[ \\t]+\\r?\\n", (), "line of white space only"),
    ("SPC-003", W, "raw", "re", "\\n +\\t+[^ \\t\\n]", (), "tab behind blanks in the indent"),
    ("SPC-004", W, "raw", "re", "\\r[^\\n]", (), "carriage return without line feed"),
    ("SPC-005", I, "raw", "re", "\\t\\n", (), "tab at a line's end"),
    ("SPC-006", I, "prose", "re", "\\n( +\\t|\\t+ )[ \\t]*", (), "indent of blanks and tabs"),
    ("SPC-007", I, "raw", "re", "\\n([ \\t\\r]*\\n){3,}", (), "three blank lines or more"),
    ("SPC-008", I, "raw", "re", "\\n\\n[ \\t]+[^ \\t\\n\\\\]", (), "paragraph begins with white space"),
    ("SPC-009", W, "raw", "re", "\\n~", (), "tie at a line's start"),
    ("SPC-010", I, "nomath", "re", "\\.  +[A-Z]", (), "two blanks behind a sentence"),
    ("SPC-012", E, "raw", "re", "[^\\x{FEFF}]\\x{FEFF}", (), "byte order mark not at the start"),
    ("SPC-013", I, "raw", "re", "\\n\\n[ \\t]+\\n\\n", (), "paragraph of white space only"),
    ("SPC-014", I, "raw", "all", ["\\r\\n", "[^\\r]\\n"], (), "mixed line endings in a paragraph"),
    ("SPC-015", I, "raw", "re", "\\n {9,}", (), "indent of more than eight blanks"),
    ("SPC-016", W, "nomath", "re", " ;", (), "blank before a semicolon"),
    ("SPC-017", I, "nomath", "re", "[0-9](mm|cm|km|kg|mg|lb|oz|ml)[^A-Za-z]", (), "number and unit run together"),
    ("SPC-018", I, "prose", "re", "[a-z]\\.[A-Z]", (), "no blank behind a sentence"),
    ("SPC-019", W, "raw", "re", "\\x{3000}\\n", (), "full-width blank at a line's end"),
    ("SPC-020", W, "math", "re", "\\t", (), "tab in mathematics"),
    ("SPC-021", W, "nomath", "re", " :", (), "blank before a colon"),
    ("SPC-022", I, "raw", "re", "\\\\item\\t", (), "tab behind an item"),
    ("SPC-023", I, "raw", "re", "[^\\x{AB}:;!?]\\x{A0}[^\\x{BB}:;!?]", (), "hard blank outside French punctuation"),
    ("SPC-024", I, "raw", "re", "\\n[ ]+\\n", (), "blanks on an empty line"),
    ("SPC-025", I, "raw", "re", " (\\\\dots|\\x{2026})", (), "blank before an ellipsis"),
    ("SPC-027", W, "raw", "re", "\\\\url\\{[^}]*[ \\t]+\\}", (), "blank at the end of a URL"),
    ("SPC-028", W, "raw", "needle", ("~", 2), (), "ties in a row"),
    ("SPC-029", W, "raw", "re", "\\n\\x{A0}", (), "indent of hard blanks"),
    ("SPC-030", W, "raw", "re", "\\n\\x{3000}", (), "full-width blank at a line's start"),
    ("SPC-031", I, "prose", "re", "\\. {3}", (), "three blanks behind a period"),
    ("SPC-032", I, "raw", "re", "\\n(\\x{A0} | \\x{A0})", (), "indent of hard and plain blanks"),
    ("SPC-033", I, "raw", "re", "\\x{A0}(\\x{2014}|---)", (), "hard blank before a dash"),
    ("SPC-034", I, "prose", "re", "\\x{2009}(\\x{2013}|--)", (), "thin blank before a dash"),
    ("SPC-035", I, "raw", "re", "\\n\\x{2009}", (), "thin blank at a line's start"),
    ("TYPO-001", E, "prose", "re", "\"", (), "straight quotation mark"),
    ("TYPO-002", W, "prose", "needle", ("-", 2), (), "two hyphens"),
    ("TYPO-003", W, "prose", "needle", ("-", 3), (), "three hyphens"),
    ("TYPO-004", W, "prose", "re", "``|''", (), "typewriter quotation marks"),
    ("TYPO-005", W, "prose", "needle", (".", 3), (), "three periods"),
    ("TYPO-006", E, "prose", "re", "\\t", (), "tab"),
    ("TYPO-007", I, "prose", "re", "[ \\t]+\\r?\\n", (), "blanks at a line's end"),
    ("TYPO-008", I, "prose", "needle", ("\n", 3), (), "empty lines in a row"),
    ("TYPO-009", W, "prose", "re", "\\n~", (), "tie at a line's start"),
    ("TYPO-010", I, "prose", "re", " [,.;:?!]", (), "blank before punctuation"),
    ("TYPO-012", W, "prose", "re", "[0-9]'", (), "apostrophe behind a number"),
    ("TYPO-013", W, "prose", "re", "(^|[^`])`([^`]|$)", (), "single back-tick"),
    ("TYPO-014", I, "raw", "re", " \\\\%", (), "blank before a percent sign"),
    ("TYPO-015", W, "prose", "re", "\\\\%\\\\%", (), "two percent signs"),
    ("TYPO-016", I, "prose", "re", " \\\\(cite|ref)[^a-zA-Z]", (), "no tie before a reference"),
    ("TYPO-017", I, "prose", "re", "\\\\['^`\"~=.]\\{[a-zA-Z]\\}", (), "accent command"),
    ("TYPO-018", I, "prose", "re", "[^ \\n] {2,}[^ \\n]", (), "blanks in a row"),
    ("TYPO-021", I, "prose", "re", "(\\.\\.\\.|\\x{2026})[A-Z]", (), "capital directly behind an ellipsis"),
    ("TYPO-022", I, "prose", "re", " [)\\]]", (), "blank before a closing bracket"),
    ("TYPO-024", I, "prose", "re", "[-\\x{2013}\\x{2014}]\\n", (), "dash at a line's end"),
    ("TYPO-025", W, "raw", "re", "[0-9] +(\\x{2013}|--)[0-9]", (), "blank before the dash of a range"),
    ("TYPO-026", W, "raw", "re", "[0-9]\\x{2013}[0-9]", (), "dash of a page range"),
    ("TYPO-027", I, "prose", "needle", ("!", 2), (), "exclamation marks in a row"),
    ("TYPO-028", E, "raw", "re", "\\$\\$", (), "display mathematics in double dollars"),
    ("TYPO-029", I, "nomath", "re", "\\\\ref\\{[^}]*\\} [a-zA-Z]", (), "plain blank behind a reference"),
    ("TYPO-032", W, "prose", "re", ",[ ]*\\\\cite", (), "comma before a citation"),
    ("TYPO-033", W, "prose", "re", "et\\.al", (), "et al. without a blank"),
    ("TYPO-034", I, "prose", "re", " \\\\footnote", (), "blank before a footnote"),
    ("TYPO-035", W, "raw", "re", "[^\\x{A0}\\x{202F} ][;:!?]", ("fr",), "French punctuation without a hard blank"),
    ("TYPO-036", I, "prose", "re", "[ \\t({][A-Z][A-Z]+ [A-Z][A-Z]+ [A-Z][A-Z]+", (), "words in capitals"),
    ("TYPO-037", I, "prose", "re", " ,", (), "blank before a comma"),
    ("TYPO-038", I, "prose", "re", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]+", (), "bare e-mail address"),
    ("TYPO-039", I, "nomath", "re", "https?://[^ \\t\\n}]+", (), "bare URL"),
    ("TYPO-040", I, "raw", "re", "\\$[^$\\n]{81,}\\$", (), "inline formula of more than 80 characters"),
    ("TYPO-041", I, "prose", "re", "\\.\\\\ldots|\\\\ldots\\.|,\\\\ldots", (), "ellipsis beside punctuation"),
    ("TYPO-042", I, "prose", "needle", ("?", 2), (), "question marks in a row"),
    ("TYPO-046", I, "raw", "re", "\\\\(begin|end)\\{math\\}", (), "math environment instead of dollars"),
    ("TYPO-047", I, "prose", "re", "\\\\section\\*", (), "starred section"),
    ("TYPO-048", I, "nomath", "re", "[ (]\\x{2013}[0-9]", (), "dash as a minus"),
    ("TYPO-049", I, "prose", "re", "[\\x{201C}\\x{2018}] ", (), "blank behind an opening quotation mark"),
    ("TYPO-051", W, "prose", "re", "\\x{2009}", (), "thin-space character"),
    ("TYPO-052", W, "prose", "re", "[<>]", (), "bare comparison sign in text"),
    ("TYPO-053", W, "prose", "re", "\\x{22EF}", (), "centred ellipsis character"),
    ("TYPO-054", I, "prose", "re", "[a-zA-Z]\\x{2013}[a-zA-Z]", (), "dash between words without hair spaces"),
    ("TYPO-055", I, "prose", "re", "\\\\,\\\\,", (), "thin spaces in a row"),
    ("TYPO-056", W, "prose", "re", "\\\\['^`\"~=.]\\{[a-zA-Z]\\}", (), "accent command in UTF-8 text"),
    ("TYPO-057", I, "prose", "re", "[0-9]\\x{B0}[CF]", (), "no thin space before a degree unit"),
    ("TYPO-058", W, "prose", "re", "[a-z][\\x{03B1}\\x{03B5}\\x{03BF}\\x{03C1}\\x{03BD}]|[\\x{03B1}\\x{03B5}\\x{03BF}\\x{03C1}\\x{03BD}][a-z]", (), "Greek letter in a Latin word"),
    ("TYPO-059", I, "math", "re", "[,;.][ ]*[=<>+-]", (), "punctuation before an operator"),
    ("TYPO-061", I, "prose", "re", "\\x{D7}", (), "multiplication sign in text"),
    ("TYPO-063", I, "raw", "re", "\\\\url\\{[^}]*\\x{2011}", (), "hard hyphen in a URL"),
]
