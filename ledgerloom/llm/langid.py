"""Languages of documents and of their passages, with calibrated confidence.

A sparse multinomial logistic regression over TF-IDF weighted character n-grams (hashed), trained by the
follow-the-regularised-leader (proximal) rule with an elastic-net penalty in small batches, followed by temperature
calibration of the very model in use, on sentences kept out of its training.

``read_sentences`` cuts every document into sentences once and stores them; with them it stores, per task, in how many
sentences each n-gram feature occurs, so the IDF covers the whole corpus by one sum over a fixed number of features.  Only
the fit uses a sample: sentences of about ``max_docs`` documents whose label names one language (chosen by a hash of the
key), at most ``max_sentences`` different (sentence, label) pairs.  Labels are noisy: a sentence seen often is believed if
its labels agree, any other one if a first model doesn't find its label improbable.  Cyrillic training sentences are also
given in Latin transcription, because texts may be transcribed.

Null, empty and blank texts and texts without a whole sentence have no passages.  Repeated documents get the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.sentences import sentences
from ledgerloom.session import stored

LANGUAGES = ("ru", "en", "uk", "bg", "de", "es")
BITS, ORDERS = 17, (1, 2, 3, 4)
# fixed values: names and codes by which a label names a language
NAMES = {
    "ru": "ru rus russian русский русская russisch ruso російська руски",
    "en": "en eng english английский englisch inglés ingles англійська английски",
    "uk": "uk ukr ukrainian украинский українська ukrainisch ucraniano украински",
    "bg": "bg bul bulgarian болгарский български bulgarisch búlgaro bulgaro болгарська",
    "de": "de deu ger german немецкий deutsch alemán aleman німецька немски",
    "es": "es spa spanish испанский español espanol castellano spanisch іспанська испански",
}
# fixed values: Latin transcription of Cyrillic letters, first the common form, then another one in use
LATIN = {
    "ru": "а=a б=b в=v г=g д=d е=e ё=yo/e ж=zh з=z и=i й=y/j к=k л=l м=m н=n о=o п=p р=r с=s т=t у=u ф=f х=kh/h ц=ts/c ч=ch ш=sh щ=shch/sch ъ= ы=y ь= э=e ю=yu/ju я=ya/ja",
    "uk": "а=a б=b в=v г=h/g ґ=g д=d е=e є=ie/ye ж=zh з=z и=y і=i ї=i/yi й=i/y к=k л=l м=m н=n о=o п=p р=r с=s т=t у=u ф=f х=kh/h ц=ts ч=ch ш=sh щ=shch ь= ю=iu/yu я=ia/ya ’= '=",
    "bg": "а=a б=b в=v г=g д=d е=e ж=zh з=z и=i й=y к=k л=l м=m н=n о=o п=p р=r с=s т=t у=u ф=f х=h ц=ts ч=ch ш=sh щ=sht ъ=a ь=y ю=yu я=ya",
}
IDENTIFIER = re.compile(r"\b\w*(?:\d|_|[^\W\d_](?<=[a-zа-яёіїєґ])[A-ZА-ЯЁІЇЄҐ])\w*\b")
DIGIT = re.compile(r"[\d_]")
LETTERS = re.compile(r"[^\W\d_]+")


def named_languages(label: Column) -> Column:
    """Languages a label names (array, empty if none): by code, with or without region, or by name, in any case."""
    bare = F.regexp_replace(F.coalesce(label, F.lit("")), r"\b([A-Za-z]{2,3})[-_](?:[A-Za-z]{4}[-_])?(?:[A-Z]{2}|[a-z]{2}|[0-9]{3})\b", "$1")
    words = F.split(F.lower(bare), r"[^\p{L}]+")
    mapping = F.create_map(*(F.lit(x) for k, names in NAMES.items() for n in names.split() for x in (n, k)))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(mapping, w)), lambda x: x.isNotNull()))


def prose(sentence: str) -> str:
    """Lower-case words of a sentence without identifiers, padded for n-grams at word borders."""
    low = sentence.lower()
    if low[1:] != sentence[1:] or DIGIT.search(sentence):  # else no word can be an identifier
        low = IDENTIFIER.sub(" ", sentence).lower()
    return " " + " ".join(LETTERS.findall(low)) + " "


def latin(text: str, language: str, variant: int) -> str:
    table = {}
    for pair in LATIN[language].split():
        a, _, b = pair.partition("=")
        forms = b.split("/")
        table[ord(a)] = forms[min(variant, len(forms) - 1)]
    return text.translate(table)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of the hashed character n-grams of each text, sorted by row."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    keys = []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(1_000_003) + codes[n - 1 :][:m] + np.uint64(n)
        inside = row[:m] == row[n - 1 :]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        feature = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
        if n in ORDERS:
            keys.append((row[:m][inside] << BITS) | feature[inside])
    flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
    unique, count = np.unique(flat, return_counts=True)
    return unique >> BITS, unique & ((1 << BITS) - 1), count.astype(np.float32)


@dataclass
class LanguageModel:
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    languages: tuple[str, ...] = LANGUAGES

    def logits(self, texts: list[str]) -> np.ndarray:
        row, feature, value = weighted(texts, self.idf)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.float32)
        if len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[starts]] = np.add.reduceat(value[:, None] * self.weights[feature], starts)
        return out + self.bias

    def predict(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, a row per text."""
        z = self.logits(texts).astype(np.float64) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def weighted(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value): TF-IDF vectors of unit length."""
    row, feature, count = grams(texts)
    value = count * idf[feature]
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
    return row, feature, (value / np.maximum(norm[row], 1e-9)).astype(np.float32)


def _ftrl(texts: list[str], labels: np.ndarray, importance: np.ndarray, idf: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int, batch: int = 128):
    d, k = 1 << BITS, len(LANGUAGES)
    row, feature, value = weighted(texts, idf)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    z, n = np.zeros((d + 1, k), dtype=np.float32), np.zeros((d + 1, k), dtype=np.float32)

    def active(zi, ni):
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)).astype(np.float32)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            # every text's features and, as the last one, the bias
            ids = np.concatenate([x for i in rows for x in (feature[bounds[i] : bounds[i + 1]], [d])])
            x = np.concatenate([v for i in rows for v in (value[bounds[i] : bounds[i + 1]], np.ones(1, dtype=np.float32))])
            sizes = bounds[rows + 1] - bounds[rows] + 1
            by = np.argsort(ids, kind="stable")  # one sort serves the look-up of weights and the sums of gradients
            first = np.r_[True, ids[by][1:] != ids[by][:-1]]
            used, starts = ids[by][first], np.flatnonzero(first)
            place = np.empty(len(ids), dtype=np.int64)
            place[by] = np.cumsum(first) - 1
            zi, ni = z[used], n[used]
            w = active(zi, ni)
            s = np.add.reduceat(x[:, None] * w[place], np.r_[0, np.cumsum(sizes)[:-1]])
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= importance[rows, None]
            g = np.add.reduceat(x[by, None] * np.repeat(p, sizes, axis=0)[by].astype(np.float32), starts)
            z[used] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[used] = ni + g * g
    w = active(z, n)
    return w[:d], w[d]


def sentence_idf(frequency: np.ndarray, sentences_seen: int) -> np.ndarray:
    """IDF of every feature from the number of sentences that hold it."""
    return np.log((1 + sentences_seen) / (1 + frequency)).astype(np.float32) + 1


def fit(
    labelled: list[tuple[str, str, float]], idf: np.ndarray | None = None, epochs: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.02, seed: int = 7
) -> LanguageModel:
    """Model of (prose, language, count) rows; the labels may be wrong in a minority of cases.  Without ``idf`` the given
    sentences are the corpus.

    A text that carries several labels is taken with the one seen most, if that has three fifths of the weight.
    """
    votes: dict[str, np.ndarray] = {}
    for t, k, n in labelled:
        if len(t) > 8 and k in LANGUAGES:
            votes.setdefault(t, np.zeros(len(LANGUAGES)))[LANGUAGES.index(k)] += n
    texts = sorted(t for t, v in votes.items() if v.max() >= 0.6 * v.sum())
    if not texts:  # nothing to learn from: every language is as likely
        zero = np.zeros((1 << BITS, len(LANGUAGES)), dtype=np.float32)
        return LanguageModel(zero, zero[0], np.ones(1 << BITS, dtype=np.float32), 1.0)
    labels = np.array([int(votes[t].argmax()) for t in texts])
    seen = np.array([votes[t].sum() for t in texts])
    agreed = np.array([votes[t].max() / votes[t].sum() for t in texts])
    importance = (1 + np.minimum(np.log2(seen), 4)).astype(np.float32)
    if idf is None:
        idf = sentence_idf(np.bincount(grams(texts)[1], minlength=1 << BITS), len(texts))
    rng = np.random.default_rng(seed)
    often = (seen >= 4) & (agreed >= 0.75)
    held = (rng.random(len(texts)) < 0.1) & ~often
    half = rng.random(len(texts)) < 0.5

    def train(keep: np.ndarray, epochs: int) -> LanguageModel:
        at = np.flatnonzero(keep)
        rows, ks, weight = [texts[i] for i in at], labels[at], importance[at]
        extra = [i for i in at if LANGUAGES[labels[i]] in LATIN and (often[i] or rng.random() < 0.4) and re.search(r"[а-я]{3}", texts[i])]
        rows += [latin(texts[i], LANGUAGES[labels[i]], int(rng.integers(2))) for i in extra]
        return LanguageModel(*_ftrl(rows, np.concatenate([ks, labels[extra]]), np.concatenate([weight, importance[extra]]), idf, epochs, alpha, beta, l1, l2, seed), idf, 1.0)

    # each half's labels are judged by a model of the other half, so that no wrong label is believed for being known by
    # heart; the model in use is fitted on what is trusted and calibrated on what it hasn't seen
    trust = often.copy()
    for side in (half, ~half):
        if (other := side | often).any() and (~other).any():
            at = np.flatnonzero(~other)
            trust[at] = train(other, 1).predict([texts[i] for i in at])[np.arange(len(at)), labels[at]] > 0.2
    if not (trust & ~held).any():
        trust, held = np.ones(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool)
    model = train(trust & ~held, epochs)
    check = np.flatnonzero(held & trust)
    if len(check):
        model.temperature = _temperature(model.logits([texts[i] for i in check]).astype(np.float64), labels[check])
    return model


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, one error among the seen cases granted (else a faultless sample would
    make every confidence 1)."""
    doubt = 1 / (len(y) + 2)
    target = np.full(z.shape, doubt / max(z.shape[1] - 1, 1))
    target[np.arange(len(y)), y] = 1 - doubt

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-np.mean((target * (s - np.log(np.exp(s).sum(axis=1, keepdims=True)))).sum(axis=1)))

    return float(min(np.geomspace(0.02, 5, 80), key=loss))


READ = "start int, stop int, prose string, features array<int>, counts array<int>"


def read_sentences(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """key, keep..., start, stop, prose of every sentence of every document, stored once.  Rows without ``prose`` hold, in
    ``features`` and ``counts``, what a task has counted: the sentences each n-gram feature occurs in."""
    kind = docs.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in READ.split(", ")]
    if {key, *keep} & set(names):
        raise ValueError(f"kept columns may not be called {names}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                heads = list(zip(part[key], *(part[c] for c in keep)))
                rows = [(*h, a, b, p) for h, t in zip(heads, part[text]) if isinstance(t, str) for a, b, s in sentences(t) if (p := prose(s)).strip()]
                out = pd.DataFrame(rows, columns=[key, *keep, *names[:3]])
                different = out["prose"].value_counts()
                if len(different):
                    row, feature, _ = grams(different.index.tolist())
                    total += np.bincount(feature, different.to_numpy()[row], minlength=1 << BITS).astype(np.int64)
                yield out.assign(features=None, counts=None)
        at = np.flatnonzero(total)
        if len(at):
            end = dict.fromkeys([key, *keep, *names]) | {"features": at.astype(np.int32), "counts": total[at].astype(np.int32)}
            yield pd.DataFrame([end]).astype({key: part[key].dtype if part[key].dtype == object else "Int64"})

    kept = "".join(f", `{c}` string" for c in keep)
    return stored(docs.select(key, text, *keep).mapInPandas(run, f"`{key}` {kind}{kept}, {READ}"))


def corpus_idf(read: DataFrame) -> np.ndarray:
    """IDF over all sentences of the corpus: at most 2**BITS sums reach the driver."""
    counted = read.where("features IS NOT NULL").select(F.inline(F.arrays_zip("features", "counts"))).groupBy("features").agg(F.sum("counts").alias("n")).toPandas()
    frequency = np.zeros(1 << BITS, dtype=np.int64)
    frequency[counted["features"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    return sentence_idf(frequency, read.where("prose IS NOT NULL").count())


def training_sentences(read: DataFrame, label: str, key: str, max_docs: int = 6000, max_sentences: int = 24_000) -> list[tuple[str, str, float]]:
    """(prose, language, count) of sentences in documents whose label names exactly one language: about ``max_docs``
    documents, chosen by a hash of the key, and ``max_sentences`` different (sentence, label) pairs, the most
    frequent ones first and then by a hash of the sentence.  The sample keeps the corpus's own mixture, in which wrong labels are outvoted."""
    named = named_languages(F.col(label))
    one = read.where("prose IS NOT NULL").select(F.col(key).alias("__key"), "prose", F.when(F.size(named) == 1, named[0]).alias("__lang")).where("__lang IS NOT NULL")
    total = one.agg(F.approx_count_distinct("__key")).first()[0]  # sets the size of the sample only
    chosen = one.where(F.pmod(F.xxhash64("__key"), F.lit(1_000_003)) < min(1.0, max_docs / max(total, 1)) * 1_000_003)
    counted = chosen.groupBy("prose", F.col("__lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return [(r.prose, r.lang, float(r.n)) for r in counted.orderBy(F.col("n").desc(), F.xxhash64("prose"), "lang").limit(max_sentences).collect()]


def passages(read: DataFrame, key: str, model: LanguageModel, *keep: str) -> DataFrame:
    """key, keep..., start, stop, lang, confidence, best, n_sentences: runs of sentences in one language, with offsets in
    code points of the stored text, in one pass over the sentences of ``read_sentences`` (a document's sentences are
    stored together and in order).  ``keep`` are string columns passed through."""
    shared = read.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**BITS features
    kind = read.schema[key].dataType.simpleString()
    fields = ("start", "stop", "lang", "confidence", "best", "n_sentences")
    if {key, *keep} & set(fields):
        raise ValueError(f"kept columns may not be called {fields}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known: dict[str, tuple[int, float]] = {}
        last: list | None = None
        for batch in batches:
            if len(known) > 100_000:
                known = {}
            new = sorted(set(batch["prose"]) - known.keys())
            for i in range(0, len(new), 2000):
                p = m.predict(new[i : i + 2000])
                known.update(zip(new[i : i + 2000], zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist())))
            rows: list[list] = []
            for h, a, b, s in zip(zip(batch[key], *(batch[c] for c in keep)), batch["start"], batch["stop"], batch["prose"]):
                lang, conf = known[s]
                if last and last[0][0] == h[0] and last[3] == lang and a >= last[2]:
                    last[2], last[4], last[5], last[6] = b, last[4] + conf, max(last[5], conf), last[6] + 1
                    continue
                if last:
                    rows.append(last)
                last = [h, a, b, lang, conf, conf, 1]
            yield _as_rows(rows, m)
        if last:
            yield _as_rows([last], m)

    def _as_rows(rows: list[list], m: LanguageModel) -> pd.DataFrame:
        return pd.DataFrame([(*h, a, b, m.languages[k], c / n, best, n) for h, a, b, k, c, best, n in rows], columns=[key, *keep, *fields])

    kept = "".join(f", `{c}` string" for c in keep)
    rows = read.where("prose IS NOT NULL").select(key, "start", "stop", "prose", *keep)
    return rows.mapInPandas(run, f"`{key}` {kind}{kept}, start int, stop int, lang string, confidence double, best double, n_sentences int")
