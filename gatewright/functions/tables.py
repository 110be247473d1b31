"""Characters and what they are folded to."""

from __future__ import annotations

# Letters of other scripts that look Latin, and the Latin text they stand for.
HOMOGLYPHS = {
    "\u0430": "a", "\u0435": "e", "\u043E": "o", "\u0440": "p", "\u0441": "c", "\u0445": "x", "\u0443": "y", "\u0456": "i", "\u0458": "j", "\u0455": "s",
    "\u0501": "d", "\u0578": "n", "\u0475": "v", "\u051B": "q", "\u051D": "w", "\u0261": "g", "\uFF4D": "m", "\u1E05": "b", "\u0433": "r", "\u043F": "n",
    "\u0438": "u", "\u043A": "k", "\u0442": "t", "\u043C": "m", "\u043D": "H", "\u043B": "n", "\u044C": "b", "\u044B": "bl", "\u0437": "3", "\u0410": "A",
    "\u0412": "B", "\u0415": "E", "\u041A": "K", "\u041C": "M", "\u041D": "H", "\u041E": "O", "\u0420": "P", "\u0421": "C", "\u0422": "T", "\u0425": "X",
    "\u0423": "Y", "\u0405": "S", "\u0406": "I", "\u0408": "J", "\u051A": "Q", "\u051C": "W", "\u0492": "F", "\u0401": "E", "\u04C0": "I", "\u03BF": "o",
    "\u03B1": "a", "\u03BD": "v", "\u03C1": "p", "\u03C4": "t", "\u03C5": "u", "\u0391": "A", "\u0392": "B", "\u0395": "E", "\u0396": "Z", "\u0397": "H",
    "\u0399": "I", "\u039A": "K", "\u039C": "M", "\u039D": "N", "\u039F": "O", "\u03A1": "P", "\u03A4": "T", "\u03A5": "Y", "\u03A7": "X", "\u03F2": "c",
    "\u03F9": "C", "\u0251": "a", "\u03B9": "i", "\u03B3": "y", "\u03C9": "w", "\u03B5": "e", "\u03BA": "k", "\u03B7": "n", "\u0585": "o", "\u057D": "u",
    "\u0581": "g", "\u0570": "h", "\u0584": "p", "\u0555": "O", "\u054D": "U", "\u0548": "N", "\u054F": "S",
}
# Only characters in these ranges are looked up above.
HOMOGLYPH_RANGES = ((0x0250, 0x02AF), (0x0370, 0x03FF), (0x0531, 0x0588), (0x0400, 0x052F), (0xFF41, 0xFF5A))

# Small capitals.
SMALL_CAPS = {
    "\u1D00": "a", "\u0299": "b", "\u1D04": "c", "\u1D05": "d", "\u1D07": "e", "\uA730": "f", "\u0262": "g", "\u029C": "h", "\u026A": "i", "\u1D0A": "j",
    "\u1D0B": "k", "\u029F": "l", "\u1D0D": "m", "\u0274": "n", "\u1D0F": "o", "\u1D18": "p", "\u01EB": "q", "\uA7AF": "q", "\u0280": "r", "\uA731": "s",
    "\u1D1B": "t", "\u1D1C": "u", "\u1D20": "v", "\u1D21": "w", "\u028F": "y", "\u1D22": "z",
}

# Upside-down letters (and the ASCII letters that are their mirror images).
UPSIDE_DOWN = {
    "\u0250": "a", "q": "b", "\u0254": "c", "p": "d", "\u01DD": "e", "\u025F": "f", "\u0183": "g", "\u0265": "h", "\u1D09": "i", "\u027E": "j",
    "\u029E": "k", "l": "l", "\u026F": "m", "u": "n", "o": "o", "d": "p", "b": "q", "\u0279": "r", "s": "s", "\u0287": "t",
    "n": "u", "\u028C": "v", "\u028D": "w", "x": "x", "\u028E": "y", "z": "z", "\u0131": "i",
}
# Glyphs that have no use but in upside-down text.
UPSIDE_DOWN_ONLY = "\u01DD\u025F\u0183\u0265\u026F\u0279\u0287\u028C\u028D\u028E\u0250\u0254\u029E\u1D09"

NEGATIVE_SQUARED = {chr(0x1F170 + i): chr(ord("a") + i) for i in range(26)}
REGIONAL_INDICATORS = {chr(0x1F1E6 + i): chr(ord("A") + i) for i in range(26)}


def live_homoglyphs() -> dict[str, str]:
    """Entries inside the looked-up ranges; the others can't fire."""
    return {k: v for k, v in HOMOGLYPHS.items() if any(a <= ord(k) <= b for a, b in HOMOGLYPH_RANGES)}
