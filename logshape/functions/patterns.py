"""Regular expressions of the tokeniser, the classifier and the scanner for values inside tokens (Java syntax).

Counted and possessive forms are on purpose: with them the time is linear in the length of a token, and a long run of brackets
does not use up the stack. Nested brackets are matched to LEVELS levels.
"""

from __future__ import annotations

LEVELS = 24
#: One-character tokens, and those that displays leave out.
DELIMITERS = '=;<>(){},"'
SKIPPED = ('"', ";", ",", "=", "<", ">", "(", ")", "{", "}", "|", "/")
TYPES = ("LIT", "NUM", "HEX", "IP", "TIME", "PATH", "ID", "PREFIX", "ARRAY", "BOOL", "PTR", "IDENT")

_HEX = "[0-9a-fA-F]"
_GROUP = f"{_HEX}{{1,4}}"
_OCTET = "[0-9]{1,3}"


def balanced(levels: int) -> str:
    """A bracketed text of that many levels at most."""
    out = r"\[[^\[\]]*+\]"
    for _ in range(levels - 1):
        out = rf"\[[^\[\]]*+(?:{out}[^\[\]]*+)*+\]"
    return out


V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_FULL = f"{_GROUP}(?::{_GROUP}){{7}}"
_SHORT = f"(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*:?)?"
_AT_MOST_SEVEN = f"(?=(?:{_HEX}{{0,4}}:){{2,7}}{_HEX}{{0,4}}(?![0-9a-fA-F:]))"
V6 = f"(?:{_FULL}|{_AT_MOST_SEVEN}{_SHORT})(?![0-9a-fA-F:])"
ARRAY = rf"\[\]|\[[^\[\],0-9]*+[,0-9][^\[\]]*+\]|\[[^\[\]]*+(?:{balanced(LEVELS - 1)}[^\[\]]*+)++\]"

#: Tokens of a line: a delimiter, a bracketed text, an unclosed bracket to the end of the line, or a run.
TOKEN = rf'[=;<>(){{}},"]|{balanced(LEVELS)}|\[[^\n]*|[^ \t\r\n=;<>(){{}},"\[][^ \t\r\n=;<>(){{}},"]*'
#: Prefixes of a token that have a form, for match_length; a timestamp and a path are told by more than a prefix.
PREFIXES = {
    "NUM": r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)",
    "HEX": rf"^0[xX]{_HEX}+",
    "IPV4": rf"^{V4}(?![0-9])(?:/[0-9]{{1,3}}|:[0-9]{{1,5}})?",
    "IPV6": rf"^{V6}(?:/[0-9]{{1,4}})?",
    "TIME": r"^[0-9:TZ.\-]+",
    "ID": rf"^{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}",
    "ARRAY": rf"^{balanced(LEVELS)}",
}
#: Values inside a literal.
SCAN = rf"{V4}(?![0-9])(?:/[0-9]{{1,3}}|:[0-9]{{1,5}})?|(?<![A-Za-z]){V6}(?:/[0-9]{{1,4}})?|0[xX]{_HEX}+|{ARRAY}"

#: The first pattern that a whole token matches gives its type; without one it is a literal.
CLASSES = (
    ("BOOL", r"^(?i:no|yes|true|false|positive|negative)\z"),
    ("PTR", r"^(?i:nil|null|none|nullptr)\z"),
    ("ID", rf"^[0-9]{_HEX}{{7}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}\z"),
    ("PREFIX", rf"^{V4}/[0-9]{{1,3}}\z"),
    ("IP", rf"^{V4}(?::[0-9]{{1,5}})?\z"),
    ("PREFIX", rf"^{V6}/[0-9]{{1,4}}\z"),
    ("IP", rf"^{V6}\z"),
    ("PREFIX", rf"^(?!:){V6}/[0-9]{{1,4}}%[^ \t]*\z"),
    ("IP", rf"^(?!:){V6}%[^ \t]*\z"),
    ("HEX", rf"^0[xX]{_HEX}+\z"),
    ("ID", rf"^{_HEX}{{32,}}\z"),
    ("HEX", rf"^{_HEX}{{8,}}\z"),
    ("TIME", r"^(?=(?:[^0-9]*[0-9]){6})(?=(?:[0-9]*[^0-9]){2})[0-9][0-9:TZ.\-]{7,}\z"),
    ("NUM", r"^(?:[0-9]+\.?[0-9]*|[+-](?:[0-9]+\.?[0-9]*|\.[0-9]+))\z"),
    ("PATH", r"^(?:/[\s\S]|\./|\.[\s\S]*:/)"),
    ("ARRAY", rf"^(?:{ARRAY})\z"),
)
#: A word with a letter that is not hexadecimal and without what other types need: BOOL, PTR or a literal.
WORD = r"^[^0-9:\[/.+\-g-zG-Z]*[g-zG-Z][^0-9:\[/.+\-]*\z"
#: Digits that are too few for another type.
SHORT_NUMBER = r"^[0-9]{1,7}\z"
#: An IPv6 address has two colons side by side, or seven.
SEVEN_COLONS = r"^(?:[^:]*+:){7}"
