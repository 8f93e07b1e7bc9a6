"""Token counts of all prefixes of one long word, by a recurrence over its bytes.

The encoding of a prefix ends with one token, and without it is the encoding of a
shorter prefix. So the last token of each prefix is that token among those which end
there whose neighbour, the last token of the shorter prefix, can stand beside it: no
merge across the two comes before the merges that make them. Each byte looks at as
many tokens as a token has bytes at most, whatever the length of the word.
"""

from __future__ import annotations

import json
from functools import lru_cache

NEVER = 1 << 60
#: Contractions that the vocabulary's pattern takes whole (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class Recurrence:
    """The merges of a vocabulary file with word ends."""

    def __init__(self, path: str, tokenizer):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.tokenizer, end = tokenizer, model["end_of_word_suffix"]
        ids, self.rank, self.parts = model["vocab"], {}, {}
        for r, m in enumerate(model["merges"]):
            a, b = (ids[x] for x in (m.split(" ") if isinstance(m, str) else m))
            t = ids["".join(m.split(" ") if isinstance(m, str) else m)]
            self.rank[a, b] = r
            self.parts.setdefault(t, (a, b, r))
        self.inner, self.last = {}, {}
        for text, t in ids.items():
            (self.last if text.endswith(end) and text != end else self.inner)[text.removesuffix(end) or text] = t
        self.longest = max(map(len, ids))
        self.right_side, self.left_side = (lru_cache(None)(lambda t, k=k: self._side(t, k)) for k in (1, 0))
        self.beside, self.whole = lru_cache(1 << 20)(self._beside), lru_cache(None)(self._whole)

    def _side(self, t: int, k: int) -> list[tuple[int, int]]:
        """The tokens at t's right (k=1) or left end while t is made, and the rank of the merge that ends each."""
        out = []
        while t in self.parts:
            out.append(t)
            t = self.parts[t][k]
        chain = [t, *reversed(out)]
        return [(x, self.parts[y][2]) for x, y in zip(chain, chain[1:], strict=False)] + [(chain[-1], NEVER)]

    def _beside(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether a and b stay two tokens: no merge of rank under `before` joins what stands at their border."""
        left, right, i, j = self.right_side(a), self.left_side(b), 0, 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            joined = self.rank.get((x, y), NEVER)
            # Of equal merges the leftmost comes first.
            if joined < before and joined < until_x and joined <= until_y:
                return False
            if until_x == until_y == NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def _whole(self, t: int) -> bool:
        """Whether the text of t is encoded as t."""
        if t not in self.parts:
            return True
        a, b, r = self.parts[t]
        return self.whole(a) and self.whole(b) and self._beside(a, b, r)

    def piece(self, symbols: str) -> list[int]:
        """Tokens of the prefixes of 1, 2, ... symbols of a piece, each as a word of its own."""
        before, count, out = [-1], [0], []
        for i in range(1, len(symbols) + 1):
            at = found = None
            for size in range(min(i, self.longest), 0, -1):
                some, p = symbols[i - size : i], before[i - size]
                if at is None and (t := self.inner.get(some)) is not None and self.whole(t) and (p < 0 or self.beside(p, t)):
                    at = t, count[i - size] + 1
                if found is None and (t := self.last.get(some)) is not None and self.whole(t) and (p < 0 or self.beside(p, t)):
                    found = count[i - size] + 1
                if at is not None and found is not None:
                    break
            before.append(at[0])
            count.append(at[1])
            out.append(found)
        return out

    def word(self, text: str) -> list[int] | None:
        """Tokens of the prefixes of 1, 2, ... characters of a word without white space.

        None where characters can't be taken one by one: texts that normalisation
        composes anew, or that may hold a special string.
        """
        normal = [self._normal(c) for c in text]
        whole = "".join(normal)
        if "<|" in text or self.tokenizer.normalizer.normalize_str(text) != whole:
            return None
        upto, of = [], 0  # tokens up to each character of the normalised text
        for symbols, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole):
            some = whole[a:b]
            if some in CONTRACTIONS:
                # Its own prefixes are a quote, and a quote and a letter.
                own = [1, 2, 2][: len(some) - 1] + [self.piece(symbols)[-1]]
            else:
                counts, own, k = self.piece(symbols), [], 0
                for c in some:
                    k += len(c.encode())
                    own.append(counts[k - 1])
            upto += [of + n for n in own]
            of += own[-1]
        out, k = [], 0
        for c in normal:
            k += len(c)
            out.append(upto[k - 1])
        return out

    @lru_cache(1 << 16)  # noqa: B019  one for each worker
    def _normal(self, c: str) -> str:
        return self.tokenizer.normalizer.normalize_str(c)
