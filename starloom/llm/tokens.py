"""Token ids and token counts of whole texts, exactly as the vocabulary's own library gives them.

The libraries encode one to two MB a second and core, most of it on words they have met before. Here a
text is cut at boundaries where no token can span, every distinct piece is encoded by the library in
batches, and the rest is column lookups. ``tests/llm/test_tokens.py`` compares with the library on whole texts.
"""

import contextlib
import functools
import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# White space as the patterns of the tokenizers library define it; Python's own \s holds more. \x20 is the blank.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ARROW_SPACE = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", SPACE)
# Cuts at each blank are safe but where the blank follows white space: such texts are cut by PIECE instead.
BLANK_IN_SPACE = rf"[{ARROW_SPACE}]\x20"
LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
# Pre-tokens end where letters meet ASCII marks or digits and where a word meets white space.
PIECE = re.compile(rf"[{SPACE}]*[{LETTER}]+(?=[!-@\[-`{{-~{SPACE}]|\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

LETTERS = re.compile(rf"\x20?[{LETTER}]+")

BATCH_BYTES = 16 << 20
KNOWN_PIECES = 2_500_000
LIBRARY_BATCH = 4096


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare name is one of the public vocabularies installed on every machine."""
    if os.path.dirname(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def balanced(texts: pa.Array, limit: int | None = None) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes each (``BATCH_BYTES`` if not named), of one text at least."""
    limit = limit or BATCH_BYTES
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


@contextlib.contextmanager
def no_collections():
    """Without looking for cycles, which takes longer than the work while millions of small lists come and go."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Memory:
    """Ids by the 128-bit hash of a piece, in flat arrays: some 40 bytes a piece, a fifth of a dictionary's."""

    def __init__(self):
        self.high = self.low = np.empty(0, np.uint64)  # the halves of the hashes, by the first
        self.begins = self.lengths = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    @property
    def full(self) -> bool:
        return len(self.high) > KNOWN_PIECES or len(self.ids) > 8 * KNOWN_PIECES

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or -1."""
        if not len(self.high):
            return np.full(len(keys), -1)
        high = np.ascontiguousarray(keys[:, 0])
        order = np.argsort(high)
        at = np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(self.high, high[order])  # in order: each search begins in the cache
        at = np.minimum(at, len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == keys[:, 1]), at, -1)

    def add(self, keys: np.ndarray, encoded: list[bytes]) -> None:
        lengths = np.fromiter(map(len, encoded), np.int32, len(encoded)) // 4
        begins = (len(self.ids) + np.cumsum(lengths) - lengths).astype(np.int32)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(encoded), np.uint32)])
        order = np.argsort(keys[:, 0])
        # Where the new ones and the known ones go when both are merged.
        new = np.searchsorted(self.high, keys[order, 0]) + np.arange(len(order))
        known = np.ones(len(self.high) + len(order), bool)
        known[new] = False

        def merged(old: np.ndarray, own: np.ndarray) -> np.ndarray:
            out = np.empty(len(known), old.dtype)
            out[known], out[new] = old, own[order]
            return out

        self.high, self.low = merged(self.high, keys[:, 0]), merged(self.low, keys[:, 1])
        self.begins, self.lengths = merged(self.begins, begins), merged(self.lengths, lengths)


def hashes(pieces: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(p, seed) for p in pieces]), np.uint64).reshape(-1, 2)


class PieceEncoder:
    """Encodes by distinct pieces. What it remembers is bounded; when that is full, it starts anew."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.written = self._written_letters()
        self.memory = Memory()

    def _pre_tokens(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _written_letters(self) -> dict[int, str]:
        """How the library writes each letter, and a blank before them, when it hands a word to its model.

        Words of letters then go to the model at once, which takes half the time. Empty if they are not
        written letter by letter.
        """
        letters = [c for c in map(chr, range(256)) if LETTERS.fullmatch(c)]
        probe = " " + "".join(letters)
        blank = "".join(self._pre_tokens(" a"))[: -len("".join(self._pre_tokens("a")))]
        written = {ord(c): "".join(self._pre_tokens(c)) for c in letters} | {ord(" "): blank}
        agree = all(self._pre_tokens(w) == [w.translate(written)] for w in (probe, probe[1:], probe[:0:-1]))
        return written if agree else {}

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        out, others, written = [b""] * len(pieces), [], self.written
        tokenize = self.tokenizer.model.tokenize
        for i, piece in enumerate(pieces):
            if written and LETTERS.fullmatch(piece):
                out[i] = array("I", [t.id for t in tokenize(piece.translate(written))]).tobytes()
            else:
                others.append(i)
        for start in range(0, len(others), LIBRARY_BATCH):
            some = others[start : start + LIBRARY_BATCH]
            batch = self.tokenizer.encode_batch([pieces[i] for i in some], add_special_tokens=False)
            for i, encoded in zip(some, batch, strict=True):
                out[i] = array("I", encoded.ids).tobytes()
        return out

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        """Remembers different words that are not known yet, by way of their pieces."""
        cut = [PIECE.findall(w) for w in words]
        parts = list({p for own in cut for p in own})
        part_keys = hashes([p.encode() for p in parts])
        new = np.flatnonzero(self.memory.find(part_keys) < 0)
        self.memory.add(part_keys[new], self._encoded([parts[i] for i in new]))
        # A word of one piece has just been learnt; the others are put together.
        several = [i for i in np.flatnonzero(self.memory.find(keys) < 0) if len(cut[i]) != 1]
        wanted = list({p for i in several for p in cut[i]})
        at = self.memory.find(hashes([p.encode() for p in wanted]))
        begins, lengths, ids = self.memory.begins[at].tolist(), self.memory.lengths[at].tolist(), self.memory.ids
        ids_of = {p: ids[b : b + n].tobytes() for p, b, n in zip(wanted, begins, lengths, strict=True)}
        self.memory.add(keys[several], [b"".join([ids_of[p] for p in cut[i]]) for i in several])

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Per text the end of its words, per word its code, per code the word: texts whose blanks are all safe cuts."""
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        first = codes[ends[:-1]]  # has no blank before it
        codes[ends[:-1]] = len(words) + np.arange(len(texts))
        return ends[1:], codes, [b" " + w for w in words] + [words[c] for c in first]

    def _odd_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        own = [PIECE.findall(t) for t in texts]
        numbers: dict[str, int] = {}
        codes = [numbers.setdefault(p, len(numbers)) for pieces in own for p in pieces]
        return np.cumsum([len(pieces) for pieces in own]), np.array(codes, np.int64), [p.encode() for p in numbers]

    def _some(self, texts: pa.Array, with_ids: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        odd = pc.match_substring_regex(texts, BLANK_IN_SPACE).to_numpy(zero_copy_only=False)
        counts, ids = np.zeros(len(texts), np.int64), [np.empty(0, np.uint32)] * (len(texts) if with_ids else 0)
        for is_odd in (False, True):
            where = np.flatnonzero(odd == is_odd)
            if not len(where):
                continue
            some = texts.take(pa.array(where))
            ends, codes, words = self._odd_words(some.to_pylist()) if is_odd else self._words(some)
            if self.memory.full:
                self.memory = Memory()
            keys = hashes(words)
            at = self.memory.find(keys)
            if (new := np.flatnonzero(at < 0)).size:
                new = new[np.unique(keys[new, 0], return_index=True)[1]]
                with no_collections():
                    self._learn([words[i].decode() for i in new], keys[new])
                at = self.memory.find(keys)
            own = self.memory.lengths[at][codes]
            after = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
            text_ends = after[ends]
            counts[where] = np.diff(text_ends, prepend=0)
            if with_ids:
                shift = (self.memory.begins[at][codes] - after[:-1]).astype(np.int32)
                where_to = np.repeat(shift, own)
                where_to += np.arange(after[-1], dtype=np.int32)
                taken = self.memory.ids[where_to]
                for i, part in zip(where, np.split(taken, text_ends[:-1]), strict=True):
                    ids[i] = part
        return counts, ids

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        return np.concatenate([np.empty(0, np.int64), *(self._some(s, False)[0] for s in balanced(texts))])

    def ids(self, texts: pa.Array, limit: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text; ``limit`` bytes of text at once."""
        for some in balanced(texts, limit):
            yield from self._some(some, True)[1]


class PieceModelEncoder:
    """For ``.model`` vocabularies. Their pieces may span blanks, so texts are encoded whole."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))

    def ids(self, texts: pa.Array, limit: int | None = None) -> Iterator[np.ndarray]:
        for some in balanced(texts, limit):
            for encoded in self.model.encode(some.to_pylist(), num_threads=1):
                yield np.array(encoded, np.uint32)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.fromiter(map(len, self.ids(texts)), np.int64, len(texts))


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The encoder of this Python worker."""
    return (PieceModelEncoder if vocabulary.endswith(".model") else PieceEncoder)(vocabulary)


def vocabulary_size(vocabulary: str) -> int:
    own = encoder(vocabulary)
    return own.model.get_piece_size() if vocabulary.endswith(".model") else own.tokenizer.get_vocab_size()
