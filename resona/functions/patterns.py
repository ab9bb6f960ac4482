"""Character classes and patterns shared by the text functions.

Java and RE2 read all of these alike. `\\w` and `\\s` are spelled out as Unicode classes, because
the short forms cover ASCII only in both engines.
"""

SPACE_CHARS = r"\t-\r\x1C-\x20\x85\p{Z}"
WORD_CHARS = r"\p{L}\p{N}_"

SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
WORD = f"[{WORD_CHARS}]"

SPACES = f"{SPACE}+"
# The same as a plain list, for trimming without a search.
SPACE_LIST = "".join(map(chr, (
    *range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
EDGE_SPACES = f"^{SPACE}+|{SPACE}+$"
NOT_WORD_SPACE = f"[^{WORD_CHARS}{SPACE_CHARS}]"
NOT_WORD_SPACE_HASH = f"[^{WORD_CHARS}{SPACE_CHARS}#]"

HASHTAG = f"#({WORD}+)"
MENTION = f"@{WORD}+"
MENTION_OR_HASHTAG = f"[@#]{WORD}+"
URL = f"(https?://{NON_SPACE}+|www\\.{NON_SPACE}+)"
URL_PREFIX = f"http{NON_SPACE}+|www{NON_SPACE}+|https{NON_SPACE}+"

# The four code point ranges that count as emoji.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]"

# Characters that may need a name when emoji are spelled out; wider than EMOJI.
PICTOGRAPH = r"[\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F300}-\x{1FAFF}]"

# One emoji of any number of code points, the longest first: flags of two letters or of tags, keycaps, and elements
# (a pictograph with its variant and skin tone) held together by joiners. Single flag letters and tones come last.
JOINER, VARIANT, TONE, FLAG_LETTER = r"\x{200D}", r"\x{FE0F}", r"[\x{1F3FB}-\x{1F3FF}]", r"[\x{1F1E6}-\x{1F1FF}]"
ELEMENT = rf"[\x{{2600}}-\x{{27BF}}\x{{2B00}}-\x{{2BFF}}\x{{1F300}}-\x{{1F3FA}}\x{{1F400}}-\x{{1FAFF}}]{VARIANT}?{TONE}?"
KEYCAP = rf"[0-9#*]{VARIANT}?\x{{20E3}}"
TAG_FLAG = r"\x{1F3F4}[\x{E0020}-\x{E007E}]+\x{E007F}"
EMOJI_SEQUENCE = rf"(?:{FLAG_LETTER}{{2}}|{KEYCAP}|{TAG_FLAG}|{ELEMENT}(?:{JOINER}{ELEMENT})*|{FLAG_LETTER}|{TONE})"

# Upper-case characters by Unicode's Uppercase property: category Lu and the letter-like symbols.
UPPERCASE = (
    r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}"
    r"\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"
)
ALPHANUMERIC = r"[\p{L}\p{N}]"
