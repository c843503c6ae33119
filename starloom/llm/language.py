"""Language identification by a byte convolutional network, trained in numpy."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import arrow_schema

WINDOW = 256
WIDTHS = (2, 3, 4)
DEPTH, FILTERS = 8, 12
PLACES = WINDOW - max(WIDTHS) + 1
AT_ONCE = 32  # windows, so that what is in work stays in the cache

MAX_LANGUAGES = 10_000  # beyond it learning stops with an error: so many values are no languages
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 6
EPOCHS, BATCH, RATE = 12, 64, 4e-3


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, zero-filled at the end, and how many each text has (an empty one too)."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    filled = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
    return np.frombuffer(filled, np.uint8).reshape(-1, WINDOW), counts


@dataclass
class Network:
    """Embedded bytes, filters of several widths, the maximum of each over a window, and softmax over languages.

    The last class is none of the languages; it has no name and is never predicted, but takes its part of the probability.
    """

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    offset: np.ndarray
    tables: tuple[np.ndarray, np.ndarray] | None = None  # made where the network is applied

    @classmethod
    def start(cls, languages: list[str], seed: int = 11) -> "Network":
        random = np.random.default_rng(seed)

        def drawn(*shape, scale):
            return (random.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            languages,
            drawn(256, DEPTH, scale=0.5),
            {w: drawn(w * DEPTH, FILTERS, scale=(w * DEPTH) ** -0.5) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            drawn(len(WIDTHS) * FILTERS, len(languages) + 1, scale=0.1),
            np.zeros(len(languages) + 1, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters.values(), *self.biases.values(), self.weights, self.offset]

    def _spans(self, windows: np.ndarray, width: int) -> np.ndarray:
        embedded = self.embedding[windows]
        spans = np.lib.stride_tricks.sliding_window_view(embedded, width, axis=1)  # n, places, depth, width
        return np.ascontiguousarray(spans[:, :PLACES].transpose(0, 1, 3, 2)).reshape(len(windows), PLACES, width * DEPTH)

    def _pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of bytes adds to the filters: as their first two bytes, and as their next two."""
        if self.tables is None:
            added = {
                (w, at): self.embedding @ self.filters[w][at * DEPTH : (at + 1) * DEPTH] for w in WIDTHS for at in range(w)
            }
            nothing = np.zeros((256, FILTERS), np.float32)

            def pairs(at):
                both = [added.get((w, at), nothing)[:, None] + added.get((w, at + 1), nothing)[None] for w in WIDTHS]
                return np.concatenate(both, axis=2).reshape(1 << 16, -1)

            self.tables = pairs(0), pairs(2)
        return self.tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Per window a probability for each language, and for none of them."""
        heads, tails = self._pair_tables()
        biases = np.concatenate(list(self.biases.values()))
        out = np.empty((len(windows), len(self.languages) + 1), np.float32)
        for low in range(0, len(windows), AT_ONCE):
            some = windows[low : low + AT_ONCE].astype(np.int32)
            pair = some[:, :-1] * 256 + some[:, 1:]
            response = heads[pair[:, :PLACES]]
            response += tails[pair[:, 2 : 2 + PLACES]]
            scores = np.maximum(response.max(axis=1) + biases, 0) @ self.weights + self.offset
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            out[low : low + AT_ONCE] = scores / scores.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Per text the language with the highest mean probability over all its windows, and that probability."""
        if not texts:
            return [], np.empty(0)
        windows, counts = windows_of(texts)
        starts = np.cumsum(counts) - counts
        means = np.add.reduceat(self.probabilities(windows).astype(np.float64), starts, axis=0) / counts[:, None]
        best = means[:, :-1].argmax(axis=1)
        return [self.languages[b] for b in best], np.minimum(means[np.arange(len(texts)), best], 1.0)

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        spans, tops, pooled = {}, {}, []
        for width in WIDTHS:
            spans[width] = self._spans(windows, width)
            response = spans[width] @ self.filters[width] + self.biases[width]
            tops[width] = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, tops[width][:, None, :], axis=1)[:, 0])
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        scores = hidden @ self.weights + self.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = scores / scores.sum(axis=1, keepdims=True)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.weights.T) * (hidden > 0)
        embedding = np.zeros_like(self.embedding)
        filters, biases = [], []
        rows = np.arange(len(windows))[:, None]
        for i, width in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            seen = spans[width][rows, tops[width]]  # n, filters, width * depth: only the best place learns
            filters.append(np.einsum("nfk,nf->kf", seen, own))
            biases.append(own.sum(axis=0))
            to_bytes = (self.filters[width].T[None] * own[:, :, None]).reshape(-1, width, DEPTH)
            bytes_seen = windows[rows[:, :, None], tops[width][:, :, None] + np.arange(width)]
            np.add.at(embedding, bytes_seen.reshape(-1), to_bytes.reshape(-1, DEPTH))
        return [embedding, *filters, *biases, hidden.T @ error, error.sum(axis=0)]

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> "Network":
        """Adam over shuffled batches."""
        random, step = np.random.default_rng(seed), 0
        parameters = self.parameters()
        first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
        for _ in range(epochs):
            order = random.permutation(len(windows))
            for low in range(0, len(order), BATCH):
                some = order[low : low + BATCH]
                step += 1
                for p, g, m, v in zip(
                    parameters, self._gradients(windows[some], labels[some]), first, second, strict=True
                ):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def strange_windows(windows: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Windows that are in none of the languages of ``windows``: bytes drawn as often as they occur but in no order, letters and
    letters with digits drawn evenly, and characters drawn from a part of Unicode that does not occur."""
    random = np.random.default_rng(seed)
    seen = {ord(c) >> 7 for c in windows.tobytes().decode("utf-8", "ignore")}
    unseen = [b for b in range(1, 0x1B0) if b not in seen and all(chr(b << 7 | c).isalpha() for c in (32, 80))]
    lower, every = b"abcdefghijklmnopqrstuvwxyz    ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = []
    for n in range(size):
        if n % 4 == 0:
            own = random.permutation(windows[random.integers(len(windows))]).tobytes()
        elif n % 4 == 3 and unseen:
            block = int(random.choice(unseen)) << 7
            own = "".join(map(chr, block + random.integers(0, 128, WINDOW))).encode("utf-8", "ignore")
            own = bytes(b if b else 32 for b in own)
        else:
            own = bytes(random.choice(list(lower if n % 4 == 1 else every), WINDOW).tolist())
        out.append(own[:WINDOW].ljust(WINDOW, b"\0"))
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, WINDOW)


def held_out(id_col: str):
    """Whether the id, as text, has a checksum of 2 modulo 4; a null id has none and is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text_col: str):
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> Network | None:
    """A network trained on at most ``docs_per_language`` documents of each language, ``WINDOWS_PER_DOC`` windows each.

    Languages are the values of ``lang_col``; more than ``MAX_LANGUAGES`` raise a ValueError. As many windows as a language has
    on average are made up that belong to none of them (``strange_windows``). Only documents
    that are not held out and have a letter are looked at; they are chosen by a hash of the id, their windows are spread
    over the whole text. This sample is all that reaches the driver. None if there is nothing to learn from.
    """
    spread = F.xxhash64(F.lit("language sample"), F.col(id_col).cast("string"))
    known = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col) & has_letter(text_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), spread.alias("spread")
    )
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1)
    counts = sorted((r.lang, r.n) for r in counts.collect())
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Twice as many as wanted by the hash alone, so that few rows meet in the window that takes the exact number.
    limits = F.create_map(
        *[F.lit(x) for lang, n in counts for x in (lang, int(-(2**63) + 2**64 * min(1, 2 * docs_per_language / n)) - 1)]
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("spread", "text"))
    sample = known.filter(F.col("spread") <= F.try_element_at(limits, F.col("lang"))).withColumn("nth", nth)
    sample = sample.filter(F.col("nth") <= docs_per_language).select("lang", "text")
    schema = "lang string, bytes binary"
    out_schema = arrow_schema(schema)

    def spread_windows(batches):
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                windows, _ = windows_of([text.encode()])
                chosen = np.unique(np.linspace(0, len(windows) - 1, WINDOWS_PER_DOC).astype(int))
                langs += [lang] * len(chosen)
                parts += [windows[c].tobytes() for c in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], schema=out_schema)

    rows = sorted(map(tuple, sample.mapInArrow(spread_windows, schema).collect()))
    languages = [lang for lang, _ in counts]
    labels = np.array([languages.index(lang) for lang, _ in rows])
    windows = np.frombuffer(b"".join(bytes(b) for _, b in rows), np.uint8).reshape(-1, WINDOW)
    strange = strange_windows(windows, -(-len(windows) // len(languages)))
    labels = np.concatenate([labels, np.full(len(strange), len(languages))])
    windows = np.concatenate([windows, strange])
    return Network.start(languages).train(windows, labels)


def predicted(network: Network | None, text_col: str = "text"):
    """A struct column of ``lang`` and ``score`` for a text: ``und`` and 0 if it is null or has no letter.

    All windows of a text count, however long it is. Without a network every text is ``und``.
    """
    unknown = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if network is None:
        return unknown

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for low in range(0, len(texts), 256):
            some, own = network.predict([t or b"" for t in texts.slice(low, 256).cast(pa.binary()).to_pylist()])
            langs += some
            scores += own.tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.when(has_letter(text_col), predict(F.col(text_col))).otherwise(unknown)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Per row the id, ``held_out``, ``lang_pred`` and ``score``, predicted from the text alone by a network that has
    learnt from the documents not held out (see ``learn``).

    A null text, or one without a letter, is ``und`` with score 0. Null ids are not held out; null languages are not
    learnt from. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    network = learn(rows, "id", "text", "lang")
    return rows.select(F.col("id"), held_out("id").alias("held_out"), predicted(network).alias("p")).select(
        F.col("id").alias(id_col), "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )
