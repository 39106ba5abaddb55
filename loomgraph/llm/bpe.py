"""BPE encoding by a prefix-sharing trie, and decoding.

Distinct words of a batch go into a trie of symbols. The encoding of a prefix is fixed by its last
token and the encoding of what stands before that token, so a depth-first walk gives each trie node
one state, its last token: the longest suffix that is a token and is compatible with the state of
the node where it begins. Two tokens are compatible if merging their joint symbols gives them back.
Prefixes shared by words are thus encoded once. The last symbol of a word carries the end mark and
is a symbol of its own.

Defined results: a null or empty text has no tokens and decodes to the empty string; rows that
repeat are encoded each; an empty table gives an empty result; an input column named like a new one
gives way to it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import by_bytes, forget, with_columns

#: Words of one generation of a cache, and chunks by their share; two generations are held.
CACHE_WORDS, CHUNK_SHARE = 120_000, 5 / 6
CACHE_PAIRS = 100_000
NEVER = 1 << 60
END = "</w>"
#: White space of the Unicode property White_Space; Python's own split also takes U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(f"[{SPACE}]+")
_encoders: dict[str, TrieBpe] = {}


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Generations:
    """A bounded cache that keeps what is asked for: a full generation becomes the older one, and entries found there move up."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """Keys in neither generation; the others are in the young one afterwards."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        absent = keys.difference(self.young)
        for key in absent.intersection(self.old):
            self.young[key] = self.old[key]
        return [*absent.difference(self.young)]


class TrieBpe:
    """Words are strings of symbols: U+0000-U+00FF for a byte, U+0100-U+01FF for the last byte of a word."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = byte_letters()
        model = spec["model"]
        if model["end_of_word_suffix"] != END or spec["decoder"] is not None:
            raise ValueError("a BPE vocabulary with word ends and no decoder is expected")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pieces = spec["pre_tokenizer"]["pretokenizers"]
        self.word_re = regex.compile(pieces[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}"))
        self.ids: dict[str, int] = {}
        self.shown: dict[int, str] = {i: t for t, i in self.special.items()}
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.shown[i] = token
                if (symbols := self.symbols(token)) is not None:
                    self.ids[symbols] = i
        self.digits: dict[int, str] = {i: str(i) for i in self.shown}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        one = {t: t for t in self.ids}  # one object for all uses of a token
        part = lambda token: one.setdefault(t := self.symbols(token), t)
        self.ranks = {(part(a), part(b)): r for r, (a, b) in enumerate(merges)}
        self.suffixes = ahocorasick.Automaton()  # finds the tokens that end at each place of a word, longest first
        for token in self.ids:
            self.suffixes.add_word(token, token)
        self.suffixes.make_automaton()
        self.rest()

    def rest(self) -> None:
        """Hold the vocabulary alone, as between tasks: what texts have left goes.

        All of it, as the few entries that stay would keep whole blocks of memory in use.
        """
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.chunks, self.known = Generations(int(CHUNK_SHARE * self.cache_words)), Generations(self.cache_words)

    def symbols(self, token: str) -> str | None:
        end = token.endswith(END) and token != END
        try:
            codes = [self.letters[c] for c in (token.removesuffix(END) if end else token)]
        except KeyError:
            return None
        if end:
            codes[-1] += 256
        return "".join(map(chr, codes))

    def merged(self, symbols: str) -> tuple[list[str], tuple[str, str, int] | None]:
        """Plain merging, lowest rank first and leftmost among equals, for strings as short as a token; and the last merge."""
        parts, last = list(symbols), None
        while len(parts) > 1:
            ranks = [self.ranks.get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
            if (low := min(ranks)) == NEVER:
                break
            i = ranks.index(low)
            last = parts[i], parts[i + 1], low
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def spines(self, token: str) -> tuple[list, list] | None:
        """The tokens on the left and right edge of a token's merge tree, each with the rank that merges it away.

        None for a vocabulary entry that merging never makes.
        """
        if token not in self.edges:
            parts, last = self.merged(token)
            if len(parts) > 1:
                self.edges[token] = None
            elif last is None:
                self.edges[token] = [(token, NEVER)], [(token, NEVER)]
            else:
                left, right, rank = last
                (first, *more), (end, *ends) = self.spines(left)[0], self.spines(right)[1]
                self.edges[token] = [(token, NEVER), (first[0], rank), *more], [(token, NEVER), (end[0], rank), *ends]
        return self.edges[token]

    def compatible(self, before: str, token: str) -> bool:
        """Whether merging the symbols of both gives both back: no merge joins their edges while both parts are there."""
        key = (before, token)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > CACHE_PAIRS:
                forget(self.pairs)
            known, ranks = True, self.ranks
            for x, x_gone in self.spines(before)[1]:
                for y, y_gone in self.spines(token)[0]:
                    rank = ranks.get((x, y), NEVER)
                    if rank < x_gone and rank <= y_gone and rank != NEVER:
                        known = False
            self.pairs[key] = known
        return known

    def encode_words(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens (as symbols) of distinct words of symbols.

        Sorted words are the leaves of their trie in depth-first order: going to the next word is
        going up to the branch both share and down again, and the states above the branch stay.
        """
        out: dict[str, list[str]] = {}
        states: list[str] = []
        pairs, edges, previous = self.pairs, self.edges, ""
        for word in sorted(words):
            branch = 0
            for a, b in zip(previous, word, strict=False):
                if a != b:
                    break
                branch += 1
            del states[branch:]
            size = branch
            for end, token in self.suffixes.iter(word):
                if end < size or (edges[token] if token in edges else self.spines(token)) is None:
                    continue  # the state is known, or merging never makes the token
                start = end + 1 - len(token)
                if start:
                    before = states[start - 1]
                    fits = pairs.get((before, token))
                    if not (self.compatible(before, token) if fits is None else fits):
                        continue
                if end > size:
                    break
                states.append(token)
                size += 1
            if size < len(word):
                raise ValueError("a byte has no token")
            tokens, at = [], size
            while at:
                tokens.append(states[at - 1])
                at -= len(tokens[-1])
            out[word] = tokens[::-1]
            previous = word
        return out

    def words(self, chunk: str) -> list[str | int]:
        """Words of a chunk without white space as symbols; special strings as their ids."""
        if chunk and chunk.isascii():  # letters alone, or with a mark behind them, are the common case and need no pattern
            if chunk.isalpha():
                text = chunk.lower()
                return [text[:-1] + chr(256 + ord(text[-1]))]
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                text = chunk[:-1].lower()
                return [text[:-1] + chr(256 + ord(text[-1])), chr(256 + ord(chunk[-1]))]
        out: list[str | int] = []
        for part in self.special_re.split(chunk) if self.special_re else [chunk]:
            if part in self.special:
                out.append(self.special[part])
                continue
            text = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for piece in self.word_re.findall(text):
                b = piece.encode()
                out.append(b[:-1].decode("latin-1") + chr(256 + b[-1]))
        return out

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of chunks into the cache, as those of their words are."""
        split = [self.words(c) for c in chunks]
        new = self.known.missing({w for words in split for w in words})
        words, ids = self.known.young, self.ids.__getitem__
        for word, tokens in self.encode_words([w for w in new if isinstance(w, str)]).items():
            words[word] = tuple(map(ids, tokens))
        words |= {i: (i,) for i in new if isinstance(i, int)}
        self.chunks.young |= {c: words[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(words.__getitem__, parts))) for c, parts in zip(chunks, split, strict=True)}

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by spaces and decoded text of each text."""
        split = [[] if not t else _SPLIT.split(t) if _OTHER_SPACE.search(t) else t.split() for t in texts]
        if new := self.chunks.missing({c for parts in split for c in parts}):
            self.learn(new)
        chunk, digits, shown = self.chunks.young.__getitem__, self.digits.__getitem__, self.shown.__getitem__
        out = []
        for parts in split:
            ids = [*chain.from_iterable(map(chunk, parts))]
            out.append((len(ids), " ".join(map(digits, ids)), " ".join(map(shown, ids))))
        return out

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder does: tokens joined by spaces, special ones kept."""
        return " ".join(self.shown[i] for i in ids)


def encoder(path: str, cache_words: int = CACHE_WORDS) -> TrieBpe:
    """The worker's encoder of a vocabulary; another size of its caches holds from when they are next emptied."""
    if path not in _encoders:
        _encoders[path] = TrieBpe(path, cache_words)
    _encoders[path].cache_words = cache_words
    return _encoders[path]


def forget_encoders() -> None:
    """Drop the worker's encoders with all that they remember."""
    _encoders.clear()


def bpe_encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", digests: bool = True, group_bytes: int = 1 << 21, cache_words: int = CACHE_WORDS, keep: bool = True) -> DataFrame:
    """Add n_tokens and, with ``digests``, ids_sha256 and decoded_sha256; else ids (array) and decoded (string).

    ``cache_words`` bounds what a worker remembers between groups of texts; without ``keep`` a worker
    forgets the vocabulary too at the end of a partition, as more workers may live than work at a time.
    Both change cost only.
    """
    fields = [("n_tokens", T.LongType())]
    fields += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]

    def work(texts: list[str | None]) -> list[list]:
        bpe = encoder(tokenizer, cache_words)
        rows: list[tuple] = []
        for start, end in by_bytes((len(t) if t else 0 for t in texts), group_bytes):
            for n, ids, decoded in bpe.encode(texts[start:end]):
                rows.append((n, _sha(ids), _sha(decoded)) if digests else (n, [*map(int, ids.split())], decoded))
        return [list(x) for x in zip(*rows, strict=True)] or [[], [], []]

    return with_columns(docs, text, fields, work, after=None if keep else forget_encoders)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
