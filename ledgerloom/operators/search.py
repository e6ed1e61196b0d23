"""Full-text, fuzzy and vector search, lookups in catalogues, and fusion of ranked lists.

A ``TextIndex`` is two stored tables, postings (sorted by term, with the term's document frequency) and documents (length
and vector norm), and two totals; a search reads the postings of the query's few terms and joins the documents they name.
Without an index, one scan counts the query's terms per document.  Terms that occur everywhere cost no skew: the sums have
map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import trigrams_column, version_parts
from ledgerloom.session import stored

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """term, key, tf."""
    return docs.select(key, F.explode(words).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, key: str, words: Column) -> DataFrame:
    return docs.select(key, F.size(words).cast("bigint").alias("len"))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows; equal scores in the order of the key."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(k)


def _count_of(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def bm25(docs: DataFrame, key: str, words: Column, query: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
    """key, score of every document that holds a query term; repeated query terms count once.

    The scan counts the query's terms per document without exploding all words; totals come from one more narrow pass.
    """
    terms = sorted(set(query))
    counted = docs.select(F.col(key), words.alias("__words"))
    words = F.col("__words")
    counted = counted.select(key, F.size(words).cast("bigint").alias("len"), *(_count_of(words, t).alias(f"tf{i}") for i, t in enumerate(terms)))
    counted = stored(counted)  # a few numbers per document, read twice
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.greatest("len", F.lit(0))).alias("avg_len"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))))
    joined = counted.join(F.broadcast(stats))  # one row
    norm = (1 - b) + b * (F.col("len") / F.greatest("avg_len", F.lit(1.0)))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + F.when(F.col(f"tf{i}") > 0, idf * (F.col(f"tf{i}") * (k1 + 1)) / (F.col(f"tf{i}") + k1 * norm)).otherwise(0.0)
    return joined.select(key, score.alias("score")).where("score > 0")


@dataclass
class TextIndex:
    key: str
    postings: DataFrame  # term, key, tf, df
    docs: DataFrame  # key, len, norm (of the TF-IDF vector)
    n: int
    avg_len: float

    @classmethod
    def build(cls, docs: DataFrame, key: str, words: Column) -> TextIndex:
        """Index of all documents; null texts have no words but count as documents."""
        post = postings(docs, key, F.coalesce(words, F.array().cast("array<string>")))
        frequency = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        n = docs.count()
        held = stored(post.join(frequency, "term").sortWithinPartitions("term"))
        idf = F.ln(F.lit(n) / F.col("df"))
        sizes = stored(held.groupBy(key).agg(F.sum("tf").alias("len"), F.sqrt(F.sum(F.pow(F.col("tf") * idf, 2))).alias("norm")))
        total = sizes.agg(F.sum("len")).first()[0] or 0
        return cls(key, held, sizes, n, total / n if n else 0.0)

    def statistics(self) -> DataFrame:
        """docs, terms, postings, avg_len: one row."""
        return self.postings.agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings")).select(F.lit(self.n).alias("docs"), "terms", "postings", F.round(F.lit(self.avg_len), 6).alias("avg_len"))

    def _hits(self, query: Sequence[str]) -> DataFrame:
        return self.postings.where(F.col("term").isin(sorted(set(query))))

    def bm25(self, query: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
        """key, score of every document that holds a query term; repeated query terms count once."""
        norm = (1 - b) + b * (F.col("len") / max(self.avg_len, 1.0))
        idf = F.ln(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * norm)
        return self._hits(query).join(self.docs, self.key).groupBy(self.key).agg(F.sum(part).alias("score"))

    def tfidf(self, query: Sequence[str]) -> DataFrame:
        """key, score: cosine of L2-normalised tf * ln(N/df) vectors."""
        times = {t: list(query).count(t) for t in query}
        hits = self._hits(query)
        idf = F.ln(F.lit(self.n) / F.col("df"))
        weight = F.try_element_at(F.create_map(*(F.lit(x) for kv in times.items() for x in kv)), F.col("term")) * idf
        asked = hits.groupBy("term").agg(F.first(weight).alias("w")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qnorm"))  # one row
        dots = hits.groupBy(self.key).agg(F.sum(F.col("tf") * idf * weight).alias("dot"))
        scored = dots.join(self.docs, self.key).join(F.broadcast(asked)).where("norm > 0 AND qnorm > 0")
        return scored.select(self.key, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score")).where("score > 0")


def tfidf(docs: DataFrame, key: str, words: Column, query: Sequence[str]) -> DataFrame:
    """One TF-IDF search over an index of its own."""
    return TextIndex.build(docs, key, words).tfidf(query)


def trigram_jaccard(docs: DataFrame, key: str, name: Column, query: str) -> DataFrame:
    """key, score: Jaccard similarity of the trigrams of names and of the query's words of three letters or more."""
    grams = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower(name), F.lit("[а-яёa-z]{3,}"), F.lit(0)), trigrams_column)))
    asked = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower(F.lit(query)), F.lit("[а-яёa-z]{3,}"), F.lit(0)), trigrams_column)))
    scored = docs.select(key, grams.alias("g"), asked.alias("q")).where(F.arrays_overlap("g", "q"))
    return scored.select(key, (F.size(F.array_intersect("g", "q")) / F.size(F.array_union("g", "q"))).alias("score"))


def blend(text: DataFrame, fuzzy: DataFrame, key: str, weight: float = 0.75) -> DataFrame:
    """Both scores over their maximum, weighted; fuzzy hits count only among text hits if there are any."""
    any_text = text.select(F.count(F.lit(1)).alias("n_text"), F.max("score").alias("max_text"))
    both = text.withColumnRenamed("score", "t").join(fuzzy.withColumnRenamed("score", "f"), key, "full").join(F.broadcast(any_text))
    both = both.where("n_text = 0 OR t IS NOT NULL")
    top_f = both.agg(F.max("f").alias("max_f"))
    score = weight * F.coalesce(F.col("t") / F.col("max_text"), F.lit(0.0)) + (1 - weight) * F.coalesce(F.col("f") / F.col("max_f"), F.lit(0.0))
    return both.join(F.broadcast(top_f)).select(key, F.round(score, 4).alias("score"))


def cosine_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 20_000, chunk: int = 50_000) -> DataFrame:
    """query, key, score, rank of the k nearest rows of every query, exactly, in blocks of queries against chunks of rows.

    The numbers of blocks and chunks follow from the numbers of rows, so a task holds at most about ``block`` queries and
    ``chunk`` rows at any scale.  It multiplies them piece by piece and keeps k per query, so what is shuffled on is k rows
    per query and chunk.  Null vectors are left out; equal scores are ranked by the key.
    """
    vectors, queries = vectors.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    n_blocks, n_chunks = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // chunk))
    part = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = queries.select(F.col(key).alias("query"), F.col(vector).alias("qv"), part(n_blocks).alias("blk")).withColumn("chk", every(n_chunks))
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"), part(n_chunks).alias("chk")).withColumn("blk", every(n_blocks))

    def unit(x: pd.Series) -> np.ndarray:
        m = np.array(x.tolist(), dtype=np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def near(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query": [], "key": [], "score": []})
        r = r.sort_values("key")
        m, keys, names, parts = unit(r["v"]).T, r["key"].to_numpy(), q["query"].to_numpy(), []
        qm = unit(q["qv"])
        for lo in range(0, len(q), 256):
            s = np.round(qm[lo : lo + 256] @ m, 9)
            if s.shape[1] > k:  # all that reach the k-th best score, for ties; then by score and key
                edge = np.partition(s, -k, axis=1)[:, -k]
                picked = [np.flatnonzero(row >= e) for row, e in zip(s, edge)]
            else:
                picked = [np.arange(s.shape[1])] * len(s)
            for i, at in enumerate(picked):
                best = at[np.argsort(-s[i][at], kind="stable")[:k]]
                parts.append(pd.DataFrame({"query": names[lo + i], "key": keys[best], "score": s[i][best]}))
        return pd.concat(parts)

    found = blocks.groupBy("blk", "chk").cogroup(rows.groupBy("blk", "chk")).applyInPandas(near, "query long, key long, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# -- fusion of ranked lists (key, score)
def min_max(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores on [0, 1]; unchanged if all are equal."""
    edge = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), F.col(score)).otherwise((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return df.join(F.broadcast(edge)).withColumn(score, scaled).drop("lo", "hi")


def weighted_fusion(a: DataFrame, b: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    x, y = min_max(a).withColumnRenamed("score", "a"), min_max(b).withColumnRenamed("score", "b")
    return x.join(y, key, "full").select(key, (alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"))


MOST_RANKED = 10_000


def ranked(df: DataFrame, key: str, limit: int = MOST_RANKED) -> DataFrame:
    """The ``limit`` best rows of a result list with ``rank`` from 1: a top-k, so the one task that numbers them is small."""
    return top(df, "score", key, limit).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(key))))


def rrf(lists: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank)."""
    if k <= 0:
        raise ValueError("k is positive")
    parts = [ranked(d, key).select(key, (1 / (F.lit(k) + F.col("rank"))).alias("score")) for d in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("score").alias("score"))


def comb(lists: Sequence[DataFrame], key: str, mnz: bool = False) -> DataFrame:
    """CombSUM of min-max scores; CombMNZ multiplies by the number of lists that hold the row."""
    parts = [min_max(d).select(key, "score") for d in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = F.sum("score") * (F.count(F.lit(1)) if mnz else F.lit(1))
    return out.groupBy(key).agg(total.alias("score"))


def word_jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def mmr(candidates: DataFrame, key: str, text: str, limit: int, trade: float = 0.7, similarity: Callable[[set[str], set[str]], float] = word_jaccard) -> DataFrame:
    """key, rank, score: greedy maximal marginal relevance among the 2 * limit best candidates (key, score, text)."""
    best = top(candidates, "score", key, 2 * limit).select(key, "score", text)
    kind = candidates.schema[key].dataType.simpleString()

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["score", key], ascending=[False, True], ignore_index=True)
        words = [set(str(t or "").lower().split()) for t in pdf[text]]
        left, chosen, scores = list(range(len(pdf))), [], []
        while left and len(chosen) < limit:
            value = lambda i: pdf["score"][i] if not chosen else trade * pdf["score"][i] - (1 - trade) * max(similarity(words[i], words[j]) for j in chosen)
            i = max(left, key=lambda i: (value(i), -i))
            scores.append(float(value(i)))
            chosen.append(i)
            left.remove(i)
        yield pd.DataFrame({key: pdf[key].iloc[chosen].to_numpy(), "rank": range(1, len(chosen) + 1), "score": scores})

    return best.coalesce(1).mapInPandas(pick, f"`{key}` {kind}, rank int, score double")


def catalogue_search(methods: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Exact name (10), then word prefix (by number of words hit), then substring (1); one row per Russian name."""
    low = query.lower()
    name = lambda c: F.lower(F.coalesce(c, F.lit("")))
    words = [w for w in low.split() if w]
    body = F.lower(F.concat_ws(" ", "name_ru", "name_en", "description"))
    hits = sum(((F.concat(F.lit(" "), body).contains(" " + w)).cast("int") for w in words), F.lit(0))
    score = F.when((name(F.col("name_ru")) == low) | (name(F.col("name_en")) == low), 10.0).when(hits > 0, 1.0 + hits).when(body.contains(low), 1.0)
    found = methods.select("id", "name_ru", score.alias("score")).where("score IS NOT NULL")
    one = found.groupBy("name_ru").agg(F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("id")).alias("i"))).alias("x")).select("x.id", "name_ru", "x.score")
    return top(one, "score", "id", limit)


# -- hybrid search: a text and a vector list of (key, score)
def hybrid(text: DataFrame, vector: DataFrame, key: str, limit: int = 10, alpha: float = 0.5) -> DataFrame:
    """key, score, source: weighted fusion of twice ``limit`` rows of each list; the source is where a row scored above 0."""
    a, b = top(text, "score", key, 2 * limit), top(vector, "score", key, 2 * limit)
    fused = weighted_fusion(a, b, key, alpha)
    told = fused.join(min_max(a).withColumnRenamed("score", "a"), key, "left").join(min_max(b).withColumnRenamed("score", "b"), key, "left")
    source = F.when((F.col("a") > 0) & (F.col("b") > 0), "both").when(F.col("a") > 0, "bm25").when(F.col("b") > 0, "vector").otherwise("none")
    return top(told.select(key, "score", source.alias("source")), "score", key, limit)


def hybrid_auto(text: DataFrame, vector: DataFrame | None, key: str, limit: int = 10) -> DataFrame:
    """Hybrid search if there is a vector list, else the text list alone (source 'bm25')."""
    if vector is None:
        return top(text, "score", key, limit).select(key, "score", F.lit("bm25").alias("source"))
    return hybrid(text, vector, key, limit)


def hybrid_reranked(text: DataFrame, vector: DataFrame, key: str, limit: int = 10, algorithm: str = "rrf", alpha: float = 0.5, k: int = 60, trade: float = 0.7, texts: DataFrame | None = None) -> DataFrame:
    """key, score, bm25_score, vector_score (as they were), source: twice ``limit`` rows of each list, reranked by ``rrf``,
    ``weighted``, ``combsum``, ``combmnz`` or ``mmr`` (which needs ``texts``: key, text)."""
    a, b = top(text, "score", key, 2 * limit), top(vector, "score", key, 2 * limit)
    if algorithm == "rrf":
        fused = rrf([a, b], key, k)
    elif algorithm == "weighted":
        fused = weighted_fusion(a, b, key, alpha)
    elif algorithm in ("combsum", "combmnz"):
        fused = comb([a, b], key, mnz=algorithm == "combmnz")
    elif algorithm == "mmr" and texts is not None:
        fused = mmr(rrf([a, b], key, k).join(texts.toDF(key, "text"), key), key, "text", limit, trade).select(key, "score")
    else:
        raise ValueError(f"no way to rerank by {algorithm}")
    told = fused.join(a.withColumnRenamed("score", "bm25_score"), key, "left").join(b.withColumnRenamed("score", "vector_score"), key, "left")
    source = F.when(F.col("bm25_score").isNotNull() & F.col("vector_score").isNotNull(), "both").when(F.col("bm25_score").isNotNull(), "bm25").otherwise("vector")
    return top(told.withColumn("source", source), "score", key, limit)


def search_auto(index: TextIndex | None, version: int, query: Sequence[str], limit: int = 10) -> DataFrame | None:
    """By the version of an index: 0 none, 1 TF-IDF, 2 BM25."""
    if index is None or version == 0:
        return None
    return top(index.tfidf(query) if version == 1 else index.bm25(query), "score", index.key, limit)


# -- look-ups in a catalogue of methods
def methods_named(methods: DataFrame, name: str, context: str | None = None) -> DataFrame:
    """Rows of a name in either language, of one context if it is given (part of the title or category); case counts not."""
    low, text = F.lit(name.lower()), lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    found = methods.where((text(F.col("name_ru")) == low) | (text(F.col("name_en")) == low))
    if context is None:
        return found
    return found.where(text(F.col("title")).contains(context.lower()) | text(F.col("category")).contains(context.lower()))


def methods_named_batch(methods: DataFrame, names: DataFrame) -> DataFrame:
    """asked and the rows of each of many names: one equi-join on the names of both languages."""
    spelled = methods.select("*", F.explode(F.array_distinct(F.array(F.lower(F.trim("name_ru")), F.lower(F.trim("name_en"))))).alias("__name")).where("__name IS NOT NULL")
    return names.select(F.col("name").alias("asked"), F.lower(F.trim("name")).alias("__name")).distinct().join(spelled, "__name").drop("__name")


def name_collisions(methods: DataFrame) -> DataFrame:
    """name, contexts, n: names that stand for methods of several categories."""
    per = methods.where("name_ru IS NOT NULL AND category IS NOT NULL").groupBy(F.lower(F.trim("name_ru")).alias("name"), F.trim("category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("name").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n")).where("contexts > 1")


# fixed values: execution contexts and the words by which an availability text names them
CONTEXTS = {"server": "сервер", "thin_client": "тонкий клиент", "web_client": "веб-клиент", "thick_client": "толстый клиент", "mobile_client": "мобильный клиент", "external_connection": "внешнее соединение"}


def available(context: str) -> Column:
    """Does the availability text name the context?  A method that says nothing is taken as available."""
    text = F.lower(F.coalesce("availability", F.lit("")))
    return (F.trim(text) == "") | text.contains(CONTEXTS[context])


def deprecated(version: str | None = None) -> Column:
    """Is the method deprecated (by the given platform version)?"""
    since = F.regexp_extract(F.coalesce("version_deprecated", F.lit("")), r"[0-9]+(?:\.[0-9]+)*", 0)
    return (since != "") if version is None else (since != "") & (version_parts(since) <= version_parts(F.lit(version)))


def since(version: str) -> Column:
    """Was the method there in a platform version?  Versions compare part by part, missing parts are 0."""
    own = F.regexp_extract(F.coalesce("version_since", F.lit("")), r"[0-9]+(?:\.[0-9]+)*", 0)
    pad = lambda v: F.slice(F.concat(version_parts(v), F.array_repeat(F.lit(0), 8)), 1, 8)
    return (own == "") | (pad(own) <= pad(F.lit(version)))


def safe_methods(methods: DataFrame, contexts: Sequence[str], version: str) -> DataFrame:
    """Methods that some of the contexts offers, that are not deprecated and were there in the version."""
    offered = F.lit(False)
    for c in contexts:
        offered = offered | available(c)
    return methods.where(offered & ~deprecated() & since(version))


def alternatives(methods: DataFrame, name: str, contexts: Sequence[str], limit: int = 5) -> DataFrame:
    """id, name_ru, score: other methods with a like name that one of the contexts offers."""
    offered = F.lit(False)
    for c in contexts:
        offered = offered | F.lower(F.coalesce("availability", F.lit(""))).contains(CONTEXTS[c])
    others = methods.where(offered & (F.lower(F.trim(F.coalesce("name_ru", F.lit("")))) != name.lower()) & (F.lower(F.trim(F.coalesce("name_en", F.lit("")))) != name.lower()))
    one = trigram_jaccard(others, "id", F.col("name_ru"), name).join(others.select("id", "name_ru"), "id")
    return top(one.groupBy("name_ru").agg(F.min("id").alias("id"), F.max("score").alias("score")), "score", "id", limit).select("id", "name_ru", "score")


# -- knowledge base, and all sources at once
def knowledge(items: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """id, title, score of knowledge-base items (id, title, keywords, content): keywords that the query holds count 10, those
    that hold the query 5, a title with the query 8, an id 5; only where nothing of that fits, the content counts 3 and 1 for
    each further hit up to 5."""
    q = query.lower()
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    words = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.when(F.lit(q).contains(F.lower(k)), 10).when(F.lower(k).contains(q), 5).otherwise(0))
    named = F.aggregate(words, F.lit(0), lambda a, x: a + x) + F.when(low("title").contains(q), 8).otherwise(0) + F.when(low("id").contains(q), 5).otherwise(0)
    hits = F.floor((F.length(low("content")) - F.length(F.replace(low("content"), F.lit(q), F.lit("")))) / max(len(q), 1)).cast("int")
    score = F.when(named > 0, named).when(hits > 0, 3 + F.least(hits - 1, F.lit(5))).otherwise(0)
    return top(items.select("id", "title", score.alias("score")).where("score > 0"), "score", "id", limit)


def holds_words(df: DataFrame, columns: Sequence[str], query: str, limit: int = 5) -> DataFrame:
    """Rows in which one of the columns holds one of the query's words of two characters or more."""
    words = sorted({w for w in query.lower().split() if len(w) >= 2})
    test = F.lit(False)
    for c in columns:
        for w in words:
            test = test | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(w)
    return df.where(test).orderBy(*columns).limit(limit)


# fixed values: names under which a request may ask for a source
SOURCE_ALIASES = {"best_practices": ("knowledge_base",), "templates": ("knowledge_base",), "bsl_templates": ("knowledge_base",), "security_rules": ("standards",), "query_standards": ("standards", "skd")}


def gather(sources: dict[str, DataFrame], wanted: Sequence[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """Rows (source, id, title) of the wanted sources, each limited by itself, and the names of those skipped."""
    asked = set(sources) if wanted is None else {x for w in wanted for x in SOURCE_ALIASES.get(w, (w,))}
    out = None
    for name, df in sources.items():
        if name in asked:
            part = df.select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), "title")
            out = part if out is None else out.unionByName(part)
    return out, sorted(set(sources) - asked)


def code_index(methods: DataFrame) -> TextIndex:
    """Index of a configuration's own methods (id, name, body): the name's words count three times."""
    from ledgerloom.functions.text import stems_column

    body = F.concat_ws(" ", "name", "name", "name", "body")
    return TextIndex.build(methods.select("id", stems_column(body).alias("__stems")), "id", F.col("__stems"))
