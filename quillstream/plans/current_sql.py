"""SQL of the current rows, shared by the oracle queries."""

CURRENT = """
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY loaded_at DESC) AS rn FROM scripts WHERE script_id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC) AS rn FROM words WHERE word_id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY char_id ORDER BY loaded_at DESC) AS rn FROM chars WHERE char_id IS NOT NULL) WHERE rn = 1),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY loaded_at DESC) AS rn FROM word_mfcc WHERE word_id IS NOT NULL) WHERE rn = 1)
"""


def sql(query: str, more: str = "") -> str:
    """A query over s (lines), w (tokens), c (letters) and m (matrices)."""
    return f"WITH {CURRENT}{', ' + more if more else ''} {query}"


# Characters with a plainer spelling that occur in texts, one by one, and those of several letters.
_SPACES = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_WIDE, _PLAIN = ("".join(chr(i + k) for i in range(0x21, 0x7F)).replace("'", "''") for k in (0xFEE0, 0))
_SPELLED = (("\u2026", "..."), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"))


def plain_width(text: str) -> str:
    """SQL of a text in its compatibility form, as far as its characters are of ordinary kinds."""
    out = f"translate({text}, '{_SPACES}{_WIDE}', '{' ' * len(_SPACES)}{_PLAIN}')"
    for a, b in _SPELLED:
        out = f"replace({out}, '{a}', '{b}')"
    return out
