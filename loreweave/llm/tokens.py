"""Token ids of the tokenizers library, encoded once for each distinct word.

The pre-tokenizers of the two vocabularies never join characters across the single blank or line break that separates two
words, so a text's ids are those of its words in turn. Words are encoded by the library and remembered up to a bound;
texts with other white space or the string of a special token are given to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np

from loreweave.llm.common import held

#: Remembered words of one worker; beyond them words are encoded anew in each batch.
MOST_WORDS = 900_000
#: Longer words are not remembered.
LONGEST = 40

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Letters of one code point in every normal form, all lower case.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: How byte-level vocabularies spell the UTF-8 bytes of these letters: bytes without a printable Latin-1 character move up by 256.
SPELT = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
SPELT |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SPELT)}
BYTE_LETTERS = {c: "".join(SPELT[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


def encoder(path: str, leading: bool, ordinary: bool = False) -> Encoder:
    """The worker's encoder for a file, shared by its tasks: what it remembers is of use to the next."""
    return held(("encoder", path, leading, ordinary), lambda: Encoder(path, leading, ordinary))


class Encoder:
    """encode(texts): the ids of each text as little-endian unsigned 32-bit bytes; null is empty.

    leading: a byte-level vocabulary whose words hold the blank before them. Otherwise white space has no ids and case none.
    Strings of special tokens get their ids, as in the library's plain call; with `ordinary` they are ordinary text.
    """

    def __init__(self, path: str, leading: bool, ordinary: bool = False, most_words: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        assert not any(x.normalized or x.single_word or x.lstrip or x.rstrip for x in added)  # they are found by their exact strings
        self.special = [] if ordinary else [x.content if leading else x.content.encode() for x in added]
        self.leading, self.most = leading, most_words
        #: Stands between words that are encoded together; one id that no such word has.
        self.between = "\n" if leading else " \x00 "
        self.mark = self._ids("\n" if leading else "\x00")
        assert len(self.mark) == 1
        self.known: dict = {} if leading else {b"": b""}
        self.points = {x: self._ids(x).tobytes() for x in ",."}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> list | None:
        """The text cut at blanks and line breaks. For leading blanks, a word after a line break begins with it, as does the first.

        None: it has the string of a special token, also in capitals that are lower-cased here, and is left to the library.
        """
        body = text if self.leading else text.encode("utf-8", "surrogatepass").translate(LOWER)
        for x in self.special:
            if x in body:
                return None
        if self.leading:
            return ("\n" + text).replace("\n", " \n").split(" ")[1:]
        return body.replace(b"\n", b" ").split(b" ")

    def _alone(self, word) -> bool:
        """Whether the word's ids don't depend on its neighbours: always, where white space is dropped."""
        if not self.leading:
            return True
        body = word[1:] if word[:1] == "\n" else word
        return body.split() == [body]

    def _encode_words(self, names: list) -> dict:
        """Words to ids. A single comma or full stop after ASCII letters is a piece of its own."""
        known, ends, pointed = self.known, ((",", ".") if self.leading else (b",", b".")), []
        asked = {}
        for w in names:
            if w[-1:] in ends and (base := w[:-1]).isalpha() and base.isascii():
                pointed.append((w, base))
                if base not in known:
                    asked[base] = None
            else:
                asked[w] = None
        texts = [(x if x[:1] == "\n" else " " + x) for x in asked] if self.leading else [x.decode("utf-8", "surrogatepass") for x in asked]
        out = dict(zip(asked, self._together(texts), strict=True))
        points = self.points if self.leading else {k.encode(): v for k, v in self.points.items()}
        for w, base in pointed:
            out[w] = (out[base] if base in out else known[base]) + points[w[-1:]]
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        joint = range(len(texts))
        if not self.leading:  # a word of lower-case Latin letters is one piece: the library's model takes it directly
            tokenize, plain = self.tokenizer.model.tokenize, LATIN.fullmatch
            for i, x in enumerate(texts):
                if plain(x):
                    x = x if x.isascii() else x.translate(BYTE_LETTERS)
                    out[i] = array("I", [t.id for t in tokenize(x)]).tobytes()
            joint = [i for i in joint if out[i] is None]
        joint = [i for i in joint if self.between.strip(" ") not in texts[i]]
        for k in range(0, len(joint), 1024):
            part = joint[k : k + 1024]
            ids = self._ids(self.between.join([texts[i] for i in part]))
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(part) - 1:  # never seen; the words are then encoded each on its own
                continue
            raw = ids.tobytes()
            for i, a, b in zip(part, [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(raw)], strict=True):
                out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole([texts[i] for i in rest]) if rest else (), strict=True):
            out[i] = x
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = [x or "" for x in texts]
        out: list[bytes] = []
        for start in range(0, len(texts), 1024):
            out += self._encode(texts[start : start + 1024])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        get, new = self.known.get, set()
        skip = 4 * self.leading
        found, lacking, plain = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            ws = self._words(text)
            if ws is None:
                plain.append(i)
                continue
            ids = list(map(get, ws))
            if None in ids:
                less = {w for w, x in zip(ws, ids, strict=True) if x is None}
                if all(map(self._alone, less - new)):
                    new |= less
                    lacking.append((i, ws, ids))
                else:
                    plain.append(i)
            else:
                found[i] = b"".join(ids)[skip:]
        if new:
            now = self._encode_words(list(new))
            for i, ws, ids in lacking:
                found[i] = b"".join([x if x is not None else now[w] for w, x in zip(ws, ids, strict=True)])[skip:]
            if len(self.known) < self.most:
                self.known.update((w, x) for w, x in now.items() if len(w) <= LONGEST)
        for i, x in zip(plain, self.whole([texts[i] for i in plain]) if plain else (), strict=True):
            found[i] = x
        return found
