"""Words of a text as evaluation matching sees them: markup, entities, case and invisible characters don't count."""

from __future__ import annotations

import html
import unicodedata

import numpy as np
import regex
import xxhash

# Names of HTML and BBCode tags that format text inside a word or line.
INLINE = "a abbr acronym b bdi bdo big center cite code color colour del dfn em email font i img ins kbd mark q s samp size small span strike strong sub sup tt u url var"
# Names of the other BBCode tags (HTML needs no list, as its brackets are unlikely in text).
BLOCK = "align attach br code hr indent justify left li list ol php pre quote right spoiler table td th tr ul video youtube"

_names = "|".join(sorted({*INLINE.split(), *BLOCK.split()}, key=len, reverse=True))
_inline = "|".join(sorted(INLINE.split(), key=len, reverse=True))
_inline_tag = regex.compile(rf"</?(?:{_inline})(?:\s[^<>]*)?/?>|\[/?(?:{_inline})(?:[=\s][^\[\]]*)?\]", regex.I)
_tag = regex.compile(rf"<!--.*?-->|</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|\[/?(?:{_names}|\*)(?:[=\s][^\[\]]*)?\]", regex.I | regex.S)
_invisible = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ\U000e0100-\U000e01ef]+")
_word = regex.compile(r"[\p{L}\p{N}]+")


def normalise(text: str) -> str:
    """The text without markup, with entities decoded however often escaped, in NFKC and folded case."""
    while "&" in text:
        decoded = html.unescape(text)
        if decoded == text:
            break
        text = decoded
    text = unicodedata.normalize("NFKC", _invisible.sub("", text))
    if "<" in text or "[" in text:
        text = _tag.sub(" ", _inline_tag.sub("", text))
    return unicodedata.normalize("NFKC", text.casefold())


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the normalised text."""
    return _word.findall(normalise(text)) if text else []


class WordHashes:
    """64-bit hashes of the words of texts, with a bounded cache."""

    def __init__(self, most: int = 1_000_000):
        self.known: dict[str, int] = {}
        self.most = most

    @staticmethod
    def of(word: str) -> int:
        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words one after another, and the number of words of each text."""
        split = [words(t) for t in texts]
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in {w for s in split for w in s}:
            if w not in known:
                known[w] = self.of(w)
        flat = np.fromiter((known[w] for s in split for w in s), np.uint64, sum(map(len, split)))
        return flat, np.array([len(s) for s in split], np.int64)
