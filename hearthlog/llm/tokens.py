"""Token ids of whole texts by a tokenizer file, word by word with remembered words."""
from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

# Words that a worker remembers.
REMEMBERED = 250_000
# letters that lower-casing and composition leave one character each
_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class WordIds:
    """Ids (little-endian unsigned 32-bit) of texts.

    A tokenizer whose pieces never hold an ASCII blank gives a text the ids
    of its words one after another. Words of plain letters are merged by the
    same ranks, all new ones of a batch at once, with a blank as the byte that
    ends a word; all others take the tokenizer's whole way.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
        # bytes first, then bytes that end a word, then the merges in their order
        symbols = [*letters, *(c + end for c in letters), *(a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]))]
        raw = [b"".join(map(byte_of.__getitem__, s.removesuffix(end))) + b" " * s.endswith(end) for s in symbols]
        self.merged = Encoding("words", pat_str="[^ ]+ ", mergeable_ranks={r: i for i, r in enumerate(raw)}, special_tokens={})
        self.ids = np.array([vocabulary[s] for s in symbols], "<u4")
        self.ends = np.array([s.endswith(end) for s in symbols])
        self.words: dict[bytes, bytes] = {}

    def _merge(self, new: list[bytes], joined: str, ends: int) -> None:
        """Learn words from their joined text, in which each has `ends` ends."""
        found = np.array(self.merged.encode_ordinary(joined + " "), np.int64)
        raw, cuts = self.ids[found].tobytes(), (4 * np.flatnonzero(self.ends[found])[ends - 1::ends] + 4).tolist()
        self.words.update(zip(new, [raw[p:q] for p, q in zip([0, *cuts], cuts)]))

    def _learn(self, new: list[bytes]) -> None:
        letters = [w for w in new if w.isalpha()]  # ASCII
        stopped = [w for w in new if w[-1] in b",." and w[:-1].isalpha()]  # the comma or stop is a piece of its own
        left = {w: w.decode("utf-8", "replace") for w in set(new).difference(letters, stopped)}
        more = {w: s for w, s in left.items() if _PLAIN.fullmatch(s)}
        both = {w: s for w, s in left.items() if s[-1] in ",." and _PLAIN.fullmatch(s, 0, len(s) - 1)}
        for words, joined, ends in ((letters, b" ".join(letters).decode(), 1), (stopped, b" ".join(stopped).decode(), 2), (list(more), " ".join(more.values()), 1), (list(both), " ".join(both.values()), 2)):
            if words:
                self._merge(words, joined.lower().replace(",", " ,").replace(".", " ."), ends)
        left = {w: s for w, s in left.items() if w not in more and w not in both}
        for w, e in zip(left, self.tokenizer.encode_batch(list(left.values()), add_special_tokens=False)):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def of_all(self, texts: list[str | None]) -> list[bytes]:
        cut = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            if b"<|" not in raw:  # lower-casing must not make one of the tokenizer's own marks
                raw = raw.lower()
            cut.append(raw.split())
        needed = set(chain.from_iterable(cut))
        new = needed.difference(self.words)
        if len(self.words) + len(new) > self.remembered:  # the words of this batch stay
            self.words = {w: self.words[w] for w in needed if w in self.words}
        if new:
            self._learn(list(new))
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def of(self, text: str | None) -> bytes:
        return self.of_all([text])[0]
