"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, id_and_text

ORDER = 4
CHARS_PER_LANG = 2_000_000  # expected bytes of labelled text that a model is fitted on
TOTAL_CHARS = 16_000_000  # and of all languages together
CALIBRATION_DOCS = 200  # expected documents of a language that its rejection is calibrated on
TOTAL_DOCS = 20_000  # and of all languages together
BROADCAST_LANGS = 100_000  # labels whose shares, two numbers each, are broadcast
FEW_DOCS = 8  # a language with fewer takes what the others need
SLICE_BYTES = 2 << 20
CELLS = 1 << 22  # numbers (words by languages) that are held at once
LETTERS = r"\p{L}[\p{L}\p{M}]*"
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BLANK = np.uint64(0x20)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of words with a blank on either side: each character's word, its place there, and the hashes of its k-grams by k."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    chars = np.full(int(sizes.sum()), BLANK, dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(chars)) - np.repeat(first, sizes)
    inner = np.ones(len(chars), dtype=bool)
    inner[first] = inner[first + sizes - 1] = False
    chars[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    one = (chars + np.uint64(1)) * MIX
    one ^= one >> np.uint64(29)
    hashes = [one]
    for _ in range(1, ORDER):
        h = np.zeros_like(one)
        h[1:] = hashes[-1][:-1] * STEP + one[1:]
        hashes.append(h ^ (h >> np.uint64(31)))
    return np.repeat(np.arange(len(words)), sizes), place, hashes


class Sparse:
    """For sorted hashes the languages that have a value, and these values."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        name, lang = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in keys])
        order = np.lexsort((lang, name))
        name = name[order]
        head = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
        self.name, self.at = name[head], np.append(head, len(name))
        self.lang, self.value = lang[order], np.concatenate(values)[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys have values, of which language, and the values."""
        if not len(self.name):
            return np.zeros(0, dtype=np.int64), self.lang, self.value
        at = np.minimum(np.searchsorted(self.name, keys), len(self.name) - 1)
        row = np.flatnonzero(self.name[at] == keys)
        at = at[row]
        many = self.at[at + 1] - self.at[at]
        entry = np.repeat(self.at[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return np.repeat(row, many), self.lang[entry], self.value[entry]


class LanguageModels:
    """Models of several languages in sorted hash arrays.

    grams[k] has the discounted probabilities of (k + 1)-grams by language, contexts[k] the share that a context leaves to the
    shorter model; where a language does not know a context that share is 1. Grams stay within a word and the blanks around it.
    Rejection: a document of n characters that is nearest to language l is foreign if its bits a character exceed
    centre[l] + width * sqrt(spread[l] + noise[l] / n), what that language's own documents need.
    """

    width = 14.0

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.floor = np.zeros(len(langs))
        self.grams: list[Sparse] = []
        self.contexts: list[Sparse] = []
        self.centre, self.spread, self.noise = np.full(len(langs), np.inf), np.zeros(len(langs)), np.zeros(len(langs))
        self.sharpness = 1.0

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits that each language's model needs for each word, and the characters predicted."""
        owner, place, hashes = _grams(words)
        p = np.tile(self.floor, (len(owner), 1))
        row, lang, value = self.grams[0].find(hashes[0])
        p[row, lang] += value
        for k in range(1, ORDER):
            use = np.flatnonzero(place >= k)
            row, lang, value = self.contexts[k].find(hashes[k - 1][use - 1])
            p[use[row], lang] *= value
            row, lang, value = self.grams[k].find(hashes[k][use])
            p[use[row], lang] += value
        p[place == 0] = 1
        heads = np.flatnonzero(place == 0)
        total = np.add.reduceat(-np.log2(p), heads, axis=0) if len(heads) else np.zeros((0, len(self.langs)))
        return total, np.diff(np.append(heads, len(owner))) - 1

    def limit(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bits a character beyond which documents of n characters that are nearest to these languages are foreign."""
        return self.centre[best] + self.width * np.sqrt(self.spread[best] + self.noise[best] / np.maximum(n, 1))


def plain(models: LanguageModels) -> dict:
    """The models as plain values: what is broadcast names no class of this package."""
    return vars(models) | {x: [vars(t) for t in getattr(models, x)] for x in ("grams", "contexts")}


def filled(values: dict) -> LanguageModels:
    def tables(rows: list[dict]) -> list[Sparse]:
        out = [Sparse.__new__(Sparse) for _ in rows]
        for t, r in zip(out, rows, strict=True):
            vars(t).update(r)
        return out

    models = LanguageModels.__new__(LanguageModels)
    vars(models).update(values | {x: tables(values[x]) for x in ("grams", "contexts")})
    return models


def _counts(words: list[str], times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order: gram hashes, their contexts' hashes, and Kneser-Ney counts.

    The longest grams and those at a word's start count occurrences; others count the different characters before them.
    """
    owner, place, hashes = _grams(words)
    out = []
    for k in range(ORDER):
        use = np.flatnonzero(place >= max(k, 1))
        gram, one = np.unique(hashes[k][use], return_index=True)
        context = hashes[k - 1][use - 1][one] if k else np.zeros(len(gram), dtype=np.uint64)
        count = np.zeros(len(gram))
        if k == ORDER - 1:
            raw = use
        else:
            raw = use[place[use] == k] if k else use[:0]
            wide = np.flatnonzero(place >= k + 1)
            _, kind = np.unique(hashes[k + 1][wide], return_index=True)
            count += np.bincount(np.searchsorted(gram, hashes[k][wide][kind]), minlength=len(gram))
        count += np.bincount(np.searchsorted(gram, hashes[k][raw]), weights=times[owner[raw]], minlength=len(gram))
        out.append((gram, context, np.maximum(count, 1)))
    return out


def fit_models(words: dict[str, tuple[list[str], np.ndarray]]) -> LanguageModels:
    """Models from each language's distinct words and how often they occur."""
    langs = sorted(words)
    by_lang = [_counts(*words[x]) for x in langs]
    models = LanguageModels(langs)
    alphabet = 1 + len(np.unique(np.concatenate([c[0][0] for c in by_lang])))
    for k in range(ORDER):
        mass, known, weight = [], [], []
        for c in by_lang:
            _, context, count = c[k]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            own, where, kinds = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(where, weights=count)
            mass.append((count - discount) / total[where])
            known.append(own)
            weight.append(discount * kinds / total)
        models.grams.append(Sparse([c[k][0] for c in by_lang], mass))
        models.contexts.append(Sparse(known, weight))
        if not k:
            models.floor = np.array([w[0] for w in weight]) / alphabet
    return models


class Scorer:
    """Sums of bits over whole texts; the bits of each distinct word are computed once."""

    def __init__(self, models: LanguageModels):
        import regex

        self.models, self.letters = models, regex.compile(LETTERS)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.total = np.zeros((0, len(self.models.langs)))
        self.size = np.zeros(0, dtype=np.int64)

    def _learn(self, raw: list[str]) -> None:
        totals, sizes, step = [self.total], [self.size], max(64, CELLS // 64 // len(self.models.langs))
        for a in range(0, len(raw), step):
            parts = [self.letters.findall(w.lower()) for w in raw[a : a + step]]
            words = [w for p in parts for w in p]
            total, size = np.zeros((len(parts), len(self.models.langs))), np.zeros(len(parts), dtype=np.int64)
            if words:
                owner = np.repeat(np.arange(len(parts)), list(map(len, parts)))
                bits, n = self.models.bits(words)
                np.add.at(total, owner, bits)
                np.add.at(size, owner, n)
            totals.append(total)
            sizes.append(size)
        self.total, self.size = np.concatenate(totals), np.concatenate(sizes)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits by text and language, and characters by text."""
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        bits, sizes, a = [np.zeros((0, len(self.models.langs)))], [np.zeros(0, dtype=np.int64)], 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE_BYTES, side="right")))
            for out, part in zip((bits, sizes), self._slice(texts.slice(a, z - a)), strict=True):
                out.append(part)
            a = z
        return np.concatenate(bits), np.concatenate(sizes)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        counts = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self.known) * len(self.models.langs) > CELLS:
            self._forget()
        found = pc.index_in(words, value_set=self.known)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            place[found.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(found.null_count)
            added = words.filter(found.is_null())
            self._learn(added.to_pylist())
            self.known = pa.concat_arrays([self.known, added])
        word = place[coded.indices.to_numpy()] if len(place) else place
        owner = np.repeat(np.arange(len(texts)), counts)
        size = np.bincount(owner, weights=self.size[word], minlength=len(texts)).astype(np.int64)
        bits, step = np.zeros((len(texts), len(self.models.langs))), max(1, CELLS // len(self.models.langs))
        for a in range(0, len(word), step):
            own = owner[a : a + step]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            bits[own[heads]] += np.add.reduceat(self.total[word[a : a + step]], heads, axis=0)
        return bits, size


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(filled(sent.value))
            m = scorer.models
            bits, n = scorer.texts(batch["text"])
            per = bits / np.maximum(n, 1)[:, None]
            best, some = per.argmin(axis=1), n > 0
            low = per[np.arange(len(per)), best]
            lang = [m.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, 1 / np.exp2(-m.sharpness * (per - low[:, None])).sum(axis=1), 0)
            arrays = [pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(~some | (low > m.limit(best, n)))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], names=["doc_id", "lang_pred", "score", "bits_per_char", "rejected"])

    return run


SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def _rates(sent):
    """Of labelled texts with letters: label, whether it is new to the model, characters, bits a character under the label's
    model, and the loss of the score for each sharpness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(filled(sent.value))
            number = {x: i for i, x in enumerate(scorer.models.langs)}
            own = np.array([number.get(x, -1) for x in batch["lang"].to_pylist()], dtype=np.int64)
            bits, n = scorer.texts(batch["text"])
            some = np.flatnonzero((n > 0) & (own >= 0))
            per, own = bits[some] / n[some][:, None], own[some]
            row = np.arange(len(some))
            loss = []
            for s in SHARPNESS:
                p = np.exp2(-s * (per - per.min(axis=1, keepdims=True)))
                loss.append(-np.log(np.maximum(p[row, own] / p.sum(axis=1), 1e-9)))
            flat = np.array(loss).T.ravel()
            losses = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(SHARPNESS)), pa.array(flat))
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [batch["lang"].take(take), batch["fresh"].take(take), pa.array(n[some]), pa.array(per[row, own]), losses],
                names=["lang", "fresh", "n", "rate", "loss"],
            )

    return run


def _word_counts(rows: DataFrame) -> dict[str, tuple[list[str], np.ndarray]]:
    """Distinct words and counts by language; the rows are a bounded sample."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))
    table = rows.select("lang", words.alias("word")).groupBy("lang", "word").count().orderBy("lang", "word").toPandas()
    return {lang: (g["word"].tolist(), g["count"].to_numpy(dtype=float)) for lang, g in table.groupby("lang")}


def fit_language_models(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    chars_per_lang: int = CHARS_PER_LANG,
    total_chars: int = TOTAL_CHARS,
    calibration_docs: int = CALIBRATION_DOCS,
) -> LanguageModels | None:
    """Models from labelled rows that are not held out; None if there are no such rows with a letter.

    Every label is learned. Bounded sample: of each language, rows by a hash of the id so that about chars_per_lang bytes are
    expected, less where all languages together would exceed total_chars; always at least one row, and not more than four fifths
    of a language that has five or more. Rejection and scores are calibrated on other rows, about calibration_docs a language and
    TOTAL_DOCS in all; they are scored where they are, and a few numbers for each of them come back. A language with fewer than
    FEW_DOCS of them takes the limits of the others, with a wide margin.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTERS) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) / 1e6
    rows = rows.withColumn("draw", draw)
    sizes = cut(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("draw").alias("least")))
    langs = sizes.count()
    if not langs:
        return None
    take = F.least(F.lit(min(chars_per_lang, max(1, total_chars // langs))) / F.col("bytes"), F.when(F.col("docs") < 5, 1.0).otherwise(0.8))
    check = F.lit(max(FEW_DOCS, min(calibration_docs, TOTAL_DOCS // langs))) / F.col("docs")
    shares = sizes.select("lang", F.greatest("least", take).alias("take"), check.alias("check"))
    drawn = rows.join(F.broadcast(shares) if langs <= BROADCAST_LANGS else shares, "lang")
    models = fit_models(_word_counts(drawn.filter("draw <= take")))
    sent = docs.sparkSession.sparkContext.broadcast(plain(models))
    seen, fresh = F.col("draw") <= F.least("take", F.col("check") / 4), (F.col("draw") > F.col("take")) & (F.col("draw") <= F.col("take") + F.col("check"))
    asked = drawn.filter(seen | fresh).select("lang", "text", (F.col("draw") > F.col("take")).alias("fresh"))
    found = asked.mapInArrow(_rates(sent), "lang string, fresh boolean, n bigint, rate double, loss array<double>").collect()
    _calibrate(models, [tuple(r) for r in found])
    return models


def _calibrate(models: LanguageModels, found: list[tuple]) -> None:
    """Centre and spread of the bits a character of known documents, and the sharpness of scores that fits best.

    found: label, whether the row is new to the model, characters, bits a character, losses.
    """
    if not found:
        return
    rates: dict[tuple[str, bool], list[tuple[int, float]]] = {}
    for lang, fresh, n, rate, _ in found:
        rates.setdefault((lang, fresh), []).append((n, rate))

    def measure(rows: list[tuple[int, float]]) -> tuple[float, float, float]:
        n, rate = np.array(rows, dtype=float).T
        off = (rate - np.median(rate)) ** 2
        return float(np.median(rate)), max(0.0025, float(np.median(off)) * 2.2), max(2.0, float(np.median(off * n)) * 2.2)

    own = {x: measure(rates[x, True]) for x in models.langs if len(rates.get((x, True), ())) >= FEW_DOCS}
    everyone = [r for (_, fresh), rows in rates.items() if fresh or not own for r in rows]
    others = tuple(np.median(list(own.values()), axis=0)) if own else measure(everyone)
    limits = []
    for x in models.langs:
        if x in own:
            limits.append(own[x])
            continue
        seen = [rate for _, rate in rates.get((x, False), [])]
        limits.append((max([others[0], *seen]) + 0.5, 4 * others[1], 4 * others[2]))
    models.centre, models.spread, models.noise = (np.array(c) for c in zip(*limits, strict=True))
    losses = np.array([r[4] for r in found if r[1]] or [r[4] for r in found])
    models.sharpness = SHARPNESS[int(losses.mean(axis=0).argmin())]


def identify(docs: DataFrame, models: LanguageModels | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, bits_per_char, rejected.

    lang_pred has the lowest cross-entropy in bits a character over the words of the whole text; `und` if the text is null or has no letter,
    or if there are no models. score is between 0 and 1, from the differences to the other languages. `rejected` marks texts without a letter
    and texts whose cross-entropy is far above what the language's own documents of that length have; without models
    nothing but texts without a letter can be told apart. Only the text is read, other columns are ignored.
    Rows are scored where they are, with no shuffle; repeated rows each get a row; empty tables stay empty.
    """
    rows = id_and_text(docs, id_col, text_col)
    if models is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_char"), (~F.col("text").rlike(LETTERS)).alias("rejected"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(plain(models))
    return rows.mapInArrow(_predict(sent), f"doc_id {kind}, lang_pred string, score double, bits_per_char double, rejected boolean")
