"""Byte-level BPE ids of whole texts, for use inside Arrow functions on the executors.

The vocabulary's pre-tokenizer never lets a token reach across a space, or a line's end, that is followed by a
character that isn't white space: such a space always opens a new pre-token, such a line's end always is one. Texts are
therefore cut there, a batch at a time. Each distinct piece of a batch is taken apart once, into letters and the
marks after them, which are pre-tokens by themselves; a bounded per-process memo holds the ids of words, only those not yet
seen go through the tokenizer's model, pieces of any other form through the whole tokenizer, and the ids of the batch are
gathered in numpy. A text that contains a special token's string is encoded whole.
"""

from __future__ import annotations

import re
import string
from array import array

import numpy as np

#: Entries of a generation of a memo in each Python worker; one takes about 200 bytes.
MEMO_ENTRIES = 300_000
#: Words and pieces longer than this are not kept in a memo.
MEMO_CHARS = 48

#: RE2: white space after a space or a line's end, or nothing.
_RAGGED = r"[ \n]([\t-\r\x1c-\x1f\x85\p{Z}]|\z)"
#: A run of these after letters is a pre-token by itself.
_MARKS = string.punctuation
_CUT = re.compile(r" (?=\S)")
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Memo:
    """What ``learn`` gives for keys. Two generations: a key that the young one lacks is taken over from the old
    one, and a full young one becomes the old one, so what is in use stays and the size is bounded."""

    def __init__(self, learn):
        self.learn, self.young, self.old = learn, {}, {}

    def get(self, keys: list[str]) -> list[bytes]:
        if len(self.young) > MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        young = self.young
        found = list(map(young.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        if new and self.old:
            for i in new:
                if (x := self.old.get(keys[i])) is not None:
                    found[i] = young[keys[i]] = x
            new = [i for i in new if found[i] is None]
        if new:
            for i, x in zip(new, self.learn([keys[i] for i in new]), strict=True):
                found[i] = x
                if len(keys[i]) <= MEMO_CHARS:
                    young[keys[i]] = x
        return found


class Encoder:
    """Encodes texts with the byte-level BPE tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.pieces, self.words, self.others = _Memo(self._pieces), _Memo(self._words), _Memo(self._whole)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, each perhaps with a space before it."""
        tokenize, out = self.model.tokenize, []
        for w in words:
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(_LETTERS)  # a space too
            elif w[0] == " ":
                w = "Ġ" + w[1:]
            out.append(array("I", [t.id for t in tokenize(w)]).tobytes())
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, each with the space before it if there is one."""
        out: list = [None] * len(pieces)
        at, lines, words, marks, rest = [], [], [], [], []
        for i, k in enumerate(pieces):
            word = k.rstrip(_MARKS)
            end = k[len(word) :]
            line = word[:1] == "\n"
            if line:
                word = word[1:]
            if (word[1:] if word[:1] == " " else word).isalpha():
                at.append(i)
                lines.append(line)
                words.append(word)
                marks.append(end)
            else:
                rest.append(i)
        kinds, ends = list(dict.fromkeys(words)), list(dict.fromkeys([*marks, "\n"]))
        known, ending = dict(zip(kinds, self.words.get(kinds), strict=True)), dict(zip(ends, self.others.get(ends), strict=True))
        for i, line, word, end in zip(at, lines, words, marks, strict=True):
            out[i] = ending["\n"] + known[word] + ending[end] if line else known[word] + ending[end]
        for i, x in zip(rest, self.others.get([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _gathered(self, lists) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) for an Arrow list of each text's pieces; all but a text's first stand for a space, too.

        A piece that begins with a line's end stands for that alone.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        begins = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        first = coded.dictionary.take(pa.array(at[begins[:-1]]))
        n, m = len(coded.dictionary), len(first)
        keys = pa.concat_arrays([coded.dictionary, first])
        bare = np.repeat([False, True], [n, m]) | pc.starts_with(keys, "\n").to_numpy(zero_copy_only=False)
        keys = pc.binary_join_element_wise(pa.array(["", " "], pa.large_string()).take(pa.array(1 - bare)), keys, pa.scalar("", pa.large_string()))
        found = self.pieces.get(keys.to_numpy(zero_copy_only=False).tolist())
        at[begins[:-1]] = n + np.arange(m)
        size = np.fromiter(map(len, found), np.int64, n + m) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), "<u4")
        many = size[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(start[at] - ends[:-1], many) + np.arange(ends[-1])]
        return ids, np.diff(ends[begins])

    def batch(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as unsigned 32-bit integers, number of ids of each text) for an Arrow array of strings; null has none.

        ``end_id`` follows the ids of each text, if it is given.
        """
        ids, many = self._ids(texts)
        return (ids, many) if end_id is None else (np.insert(ids, np.cumsum(many), np.uint32(end_id)), many + 1)

    def _ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        ragged = pc.match_substring_regex(texts, _RAGGED).to_numpy(zero_copy_only=False) & ~special
        groups = []
        if (even := np.flatnonzero(~special & ~ragged)).size:
            groups.append((even, *self._gathered(pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " "))))
        if (rows := np.flatnonzero(ragged)).size:
            cut = [_CUT.split(x) for x in texts.take(pa.array(rows)).to_pylist()]
            groups.append((rows, *self._gathered(pa.array(cut, pa.large_list(pa.large_string())))))
        if (rows := np.flatnonzero(special)).size:
            whole = [np.frombuffer(x, "<u4") for x in self._whole(texts.take(pa.array(rows)).to_pylist())]
            groups.append((rows, np.concatenate(whole), np.array([len(x) for x in whole])))
        if len(groups) == 1:
            return groups[0][1], groups[0][2]
        many = np.zeros(len(texts), np.int64)
        for rows, _, n in groups:
            many[rows] = n
        start = np.cumsum(many) - many
        out = np.empty(int(many.sum()), "<u4")
        for rows, ids, n in groups:
            out[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, many

    def ids(self, text: str | None) -> np.ndarray:
        """All ids of ``text`` (null: none) as unsigned 32-bit integers."""
        import pyarrow as pa

        return self.batch(pa.array([text], pa.large_string()))[0]


def encoder(path: str) -> Encoder:
    """The encoder of this process for the tokenizer file at ``path``."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
