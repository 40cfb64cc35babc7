"""Language identification by prediction by partial matching over bytes.

For each language a context tree of orders 3 to 0 counts which byte follows which context in
the training texts. A text's code length under a language is exact PPM with escapes of method C
and exclusions, the counts frozen after training: in a context seen n times with q distinct
followers a byte seen k times costs -log2(k / (n + q)), an unseen one first pays
-log2(q / (n + q)) and is then coded one order lower without the bytes already ruled out;
below order 0 all remaining bytes are equally likely. With frozen counts the cost of a byte
depends on the three bytes before it alone, so all costs are tabulated once, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, segment_sums, utf8, widened

UNKNOWN = "und"


class Model:
    """Tabulated code lengths in bits: costs[language][row of the context, symbol].

    Each language has a row for every context of three that its own texts have, and for every
    context of two; a context of three that it never saw costs what its last two do. So the
    tables grow with the distinct contexts of the training texts, and nothing is left out.
    """

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        used = sorted({b for texts in samples.values() for t in texts for b in set(t)})
        # Symbol 0 is the start of a text (never coded), 1 stands for each byte never seen.
        self.symbol = np.ones(256, np.int32)
        self.symbol[used] = np.arange(2, len(used) + 2)
        self.size = a = len(used) + 2
        self.unseen = 256 - len(used)
        seen = {lang: self._grams(texts) for lang, texts in samples.items()}
        own = {lang: np.unique(g[0] // a) for lang, g in seen.items()}
        # A context of any language has a number; the others have that of their last two symbols.
        contexts = np.unique(np.concatenate(list(own.values()) or [np.empty(0, np.int64)]))
        self.number = np.empty(a**3, np.int32)
        self.number[:] = len(contexts) + np.tile(np.arange(a * a, dtype=np.int32), a)
        self.number[contexts] = np.arange(len(contexts))
        self.rows, self.costs = [], []
        for lang in self.langs:
            mine = own[lang]
            row = np.append(len(mine) + contexts % (a * a), len(mine) + np.arange(a * a))
            row[np.searchsorted(contexts, mine)] = np.arange(len(mine))
            self.rows.append((row * a).astype(np.int64))
            self.costs.append(self._costs(*seen[lang], mine).astype(np.float32).ravel())

    def _grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context of three, symbol) codes and their counts."""
        a, out = self.size, []
        for t in texts:
            s = np.concatenate([np.zeros(3, np.int64), self.symbol[np.frombuffer(t, np.uint8)]])
            out.append(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:])
        return np.unique(np.concatenate(out or [np.empty(0, np.int64)]), return_counts=True)

    def _costs(self, grams: np.ndarray, counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        a = self.size

        def table(order: int, rows: int) -> np.ndarray:
            return np.bincount(grams % (a ** (order + 1)), counts, minlength=rows * a).reshape(rows, a)

        c0, c1, c2 = table(0, 1), table(1, a), table(2, a * a)
        c3 = np.zeros((len(contexts), a))
        c3[np.searchsorted(contexts, grams // a), grams % a] = counts
        # Below order 0: the bytes that no longer can be excluded, each as likely.
        left = (c0[0, 2:] == 0).sum() + self.unseen
        escaped = np.full((1, a), 1.0 / max(1, left))
        full0 = self._blend(c0, np.ones((1, a), bool), escaped)
        to0 = lambda c: self._blend(np.broadcast_to(c0, c.shape), c == 0, np.broadcast_to(escaped, c.shape))
        from1 = to0(c1)
        full1 = self._blend(c1, np.ones(c1.shape, bool), from1)
        low1 = np.tile(np.arange(a), a)
        from2 = self._blend(c1[low1], c2 == 0, from1[low1])
        full2 = self._blend(c2, np.ones(c2.shape, bool), from2)
        low2 = contexts % (a * a)
        full3 = np.empty(c3.shape)
        for k in range(0, len(c3), 4096):
            part, low = c3[k : k + 4096], low2[k : k + 4096]
            from3 = self._blend(c2[low], part == 0, from2[low])
            full3[k : k + 4096] = self._blend(part, np.ones(part.shape, bool), from3)
        self.orders = full0, full1
        with np.errstate(divide="ignore"):
            bits = -np.log2(np.concatenate([full3, full2]))
        return np.where(np.isfinite(bits), bits, 64.0)

    @staticmethod
    def _blend(counts: np.ndarray, allowed: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities by `counts` where allowed; what has no count escapes to `lower`."""
        c = np.where(allowed, counts, 0)
        n, q = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        total = np.maximum(n + q, 1)
        return np.where(c > 0, c / total, np.where(n > 0, q / total, 1.0) * lower)

    def lengths(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths in bits of each text under each language."""
        a, n = self.size, len(ends) - 1
        if not len(raw):
            return np.zeros((n, len(self.langs)))
        s = np.zeros(len(raw) + 3 * n, np.int32)
        at = np.arange(len(raw)) + np.repeat(3 * np.arange(1, n + 1), np.diff(ends))
        s[at] = self.symbol[raw]
        numbers = self.number[(s[:-3] * a + s[1:-2]) * a + s[2:-1]][at - 3]
        coded = s[at]
        out = np.zeros((n, len(self.langs)))
        step = 1 << 20
        for k in range(0, len(raw), step):  # bounded memory on very long texts
            part = slice(k, k + step)
            cut = np.clip(ends, k, min(k + step, len(raw))) - k
            for lang, (rows, costs) in enumerate(zip(self.rows, self.costs)):
                out[:, lang] += segment_sums(costs[rows[numbers[part]] + coded[part]], cut)
        return out


def train(docs: DataFrame, training: Column, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", docs_per_lang: int = 300, longest: int = 20_000) -> Model:
    """A model from a bounded sample: of each language some `docs_per_lang` training texts, those
    whose ids hash into the lowest docs_per_lang / n part, the ones over `longest` bytes passed
    over; a language without any of these is learned from its shortest text. That fits a
    classifier, so a bound is in order: at most twice languages x docs_per_lang x longest bytes
    and one text a language come to the driver, however often ids repeat."""
    labelled = docs.where(training & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    keyed = labelled.select(F.col(lang_column).alias("lang"), F.xxhash64(F.col(id_column)).alias("h"), F.col(text_column).alias("text"))
    size = F.octet_length("text")
    found = keyed.groupBy("lang").agg(F.count(F.when(size <= longest, 1)).alias("n"), F.min(F.struct(size, "h")).alias("least")).collect()
    share = {r.lang: min(1.0, docs_per_lang / max(1, r.n)) for r in found}
    bounds = {lang: min(2**63 - 1, int(-(2**63) + s * 2**64)) for lang, s in share.items()}
    if not bounds:
        return Model({})
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
    rows = keyed.where((F.col("h") <= bound[F.col("lang")]) & (size <= longest)).select("lang", "text")
    samples: dict[str, list[bytes]] = {}
    for r in rows.limit(2 * docs_per_lang * len(bounds)).collect():
        samples.setdefault(r.lang, []).append(r.text.encode("utf-8", "replace"))
    for r in found:
        if r.lang not in samples:
            text = keyed.where((F.col("lang") == r.lang) & (size == r.least[0]) & F.col("h").eqNullSafe(r.least[1])).agg(F.min("text")).first()[0]
            samples[r.lang] = [text.encode("utf-8", "replace")]
    return Model({lang: sorted(texts)[: 2 * docs_per_lang] for lang, texts in samples.items()})


def has_letter(column: pa.Array, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = raw | 0x20
    plain = segment_sums(((low >= 97) & (low <= 122) & (raw < 128)).astype(np.uint8)[:, None], ends)[:, 0] > 0
    for k in np.flatnonzero(~plain & (np.diff(ends) > 0)):
        plain[k] = any(c.isalpha() for c in column[int(k)].as_py())
    return plain


def with_languages(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and bits behind its own columns, in one pass without a join.

    Columns of these names are replaced. What they hold: see identified().
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "score", "bits")
    at, out_names = rows.columns.index(text_column), [*rows.columns, "lang_pred", "score", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(at)
            raw, ends = utf8(texts)
            letters = has_letter(texts, raw, ends)
            if model.langs:
                bits = model.lengths(raw, ends)
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
            else:
                best, least, score, letters = (np.zeros(len(letters), k) for k in (int, float, float, bool))
            best = np.where(letters, best, len(names) - 1)
            out = [pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(least / np.maximum(np.diff(ends), 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=out_names)

    return map_batches(rows, run, widened(rows, lang_pred="string", score="double", bits="double"))


def identified(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits) for each input row.

    lang_pred is the language of the shortest code (ties: first by name), score its share of
    2 ** -bits over all languages, bits that code length per byte. A text that is null or has
    no letter, or any text under a model of no language, is `und` with score 0. Repeated rows
    and null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return with_languages(rows, model).drop("text")
