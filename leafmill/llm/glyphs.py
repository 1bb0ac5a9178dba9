"""Characters that look alike (fixed values), and the tables made from them."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

# Letters of other scripts with the shape of a Latin letter: "from to" in pairs (fixed values, natural order).
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϲc ϳj ϹC ͿJ"
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ҺH аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv ѐè ёë їï ЁË ЇÏ"
ARMENIAN = "ՕO Տs օo հh"
OTHER = "ɑa ɡg ℮e"
# Kana and Chinese characters of one shape: written with the kana.
HAN = "力カ 口ロ 二ニ 工エ 八ハ 夕タ 卜ト 一ー へヘ べベ ぺペ"
# Characters without width.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿ﾠ"
# Kinds of space that stand for an ordinary one.
SPACES = "               　"


@functools.cache
def twins() -> dict[str, str]:
    """Look-alike letters to the form kept; with every mark that composes with both."""
    table = {w[0]: w[1] for part in (GREEK, CYRILLIC, ARMENIAN, OTHER, HAN) for w in part.split()}
    for other, kept in list(table.items()):
        for mark in range(0x300, 0x370):
            a, b = unicodedata.normalize("NFC", other + chr(mark)), unicodedata.normalize("NFC", kept + chr(mark))
            if len(a) == 1 and len(b) == 1:
                table.setdefault(a, b)
    return table


@functools.cache
def widths() -> dict[str, str]:
    """Full-width and half-width forms to the ordinary ones; half-width voice marks become combining ones."""
    table = {}
    for code in [*range(0xFF01, 0xFFDD), *range(0xFFE0, 0xFFEF)]:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and len(plain) == 1 and c not in INVISIBLE:
            table[c] = plain
    # Half-width Hangul letters stand alone and stay compatibility letters.
    for code in range(0xFFA1, 0xFFDD):
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c)
        table.pop(c, None)
        name = unicodedata.name(c, "").replace("HALFWIDTH ", "")
        try:
            table[c] = unicodedata.lookup(name)
        except KeyError:
            if len(plain) == 1 and plain != c:
                table[c] = plain
    table["ﾞ"], table["ﾟ"] = "゙", "゚"
    return table


@functools.cache
def one_form() -> dict[int, str | None]:
    """The table for str.translate that brings all of the above to one form, before composition."""
    table: dict[int, str | None] = {ord(a): b for a, b in {**widths(), **twins()}.items()}
    table.update({ord(c): " " for c in SPACES})
    table.update({ord(c): None for c in INVISIBLE})
    return table


@functools.cache
def _odd() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(one_form())) + "]")


def unify(text: str) -> str:
    """The consistent form of a text: compatibility widths, spaces, invisible and look-alike characters, composition."""
    if text.isascii():
        return text
    if _odd().search(text):
        text = text.translate(one_form())
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


@functools.cache
def word_codes() -> np.ndarray:
    """For each code point the code it counts as when words are compared: 0 where it is left aside (marks without
    width, punctuation, symbols), 32 for white space, else the small letter of the one form."""
    top = 0x110000
    out = np.arange(top, dtype=np.uint32)
    table = one_form()
    for code in range(0x20000):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        plain = table.get(code, c)
        if plain is None:
            out[code] = 0
            continue
        plain = plain.lower()
        plain = table.get(ord(plain), plain) if len(plain) == 1 else c
        kind = unicodedata.category(plain[0]) if plain else "Cf"
        if plain and plain.isspace():
            out[code] = 32
        elif kind[0] in "PSC":
            out[code] = 0
        else:
            out[code] = ord(plain[0])
    return out
