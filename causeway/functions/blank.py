"""What counts as white space in literals and lines: the Unicode property, as a class of regular expressions."""

BLANK = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
