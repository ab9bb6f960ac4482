"""Product categories: clean tokens, TF-IDF vectors, k-means, and a category per cluster."""

import json
import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resona.functions import text as T
from resona.functions import words
from resona.operators import kmeans, tfidf
from resona.operators.dictionary import replace_tokens
from resona.plans.skew import broadcast_checked
from resona.session import cut_lineage, discard

EMPTY = "<empty>"
OTHERS = "others"
SEED = 42
RESTARTS = kmeans.RESTARTS
MAX_K = 6
REPRESENTATIVES = 3
STOP_WORDS = words.ENGLISH_STOP_WORDS + words.PRODUCT_STOP_WORDS

# Category names are fixed values; the word lists stand in for a zero-shot text classifier.
PROTOTYPES = {
    "Cosmetics (Eye & Lip)": [
        "lipstick", "lip", "lips", "mascara", "eyeliner", "eyeshadow", "eye", "eyes", "lash", "lashes", "gloss",
    ],
    "Hair treatment": ["hair", "shampoo", "conditioner", "curl", "curls", "wig", "cheveux", "scalp", "braid", "dye"],
    "Make Up": ["makeup", "foundation", "concealer", "blush", "primer", "powder", "palette", "brush", "contour"],
    "Physical appearance": ["face", "body", "beautiful", "look", "figure", "smile", "skin", "weight", "tall", "outfit"],
    "Skin care": [
        "serum", "cream", "toner", "skincare", "spf", "moisturizer", "cleanser", "acne", "texture", "mask",
    ],
}


# ---- tokens ------------------------------------------------------------------------------------


def cluster_preprocess(
    df: DataFrame,
    text: str = "commenttext",
    stop_words: Sequence[str] = STOP_WORDS,
    lemmas: Mapping[str, str] | DataFrame = words.DEMO_LEMMAS,
    row_id: str = "commentid",
) -> DataFrame:
    """Add `tokens` and `textcleaned` (tokens joined by a space). Every row is kept. `lemmas` are a small mapping, or a
    table of any size (see `dictionary.replace_tokens`; rows then need a unique `row_id`)."""
    table = isinstance(lemmas, DataFrame)
    tokens = reduced_tokens(T.plain_text_cluster(F.col(text)), stop_words, None if table else lemmas)
    with_tokens = df.withColumn("tokens", tokens)
    if table:
        with_tokens = replace_tokens(with_tokens, row_id, lemmas)
    return with_tokens.withColumn("textcleaned", F.array_join("tokens", " "))


def tokens_by_columns(
    cleaned: Column, stop_words: Sequence[str] = STOP_WORDS, lemmas: Mapping[str, str] | None = words.DEMO_LEMMAS,
) -> Column:
    """Tokens of a cleaned text: tokenised, abbreviations expanded, short, stop and meaningless words dropped, lemmas in
    their place (without a mapping: none)."""
    tokens = T.drop_short_tokens(T.expand_slang(T.tokenize_reduce(cleaned)))
    tokens = T.drop_meaningless_tokens(T.remove_stopwords(tokens, stop_words))
    return tokens if lemmas is None else T.lemmatize(tokens, lemmas)


def reduced_tokens(
    plain: Column, stop_words: Sequence[str] = STOP_WORDS, lemmas: Mapping[str, str] | None = words.DEMO_LEMMAS,
) -> Column:
    """`tokens_by_columns(drop_unwanted_words(plain))` of texts from `plain_text_cluster`, in Arrow batches. Their words are
    plain ASCII and no step looks beyond one, so each distinct word of a batch is taken through the steps once."""
    stop, kept = frozenset(stop_words), frozenset(words.KEPT_SHORT_TOKENS)
    slang, forms = dict(words.SLANG), dict(lemmas or {})
    runs, parts, unwanted = re.compile(r"(.)\1{2,}"), re.compile("[a-z]{3,}|[a-z0-9_]+"), re.compile(T.UNWANTED)

    def of_word(word: str) -> list[str]:
        if unwanted.fullmatch(word):
            return []
        found = []
        for part in parts.findall(runs.sub(r"\1\1\1", word)):
            for t in slang.get(part, part).split(" "):
                if (len(t) >= 2 or t in kept) and t not in stop and not t.isdigit() and (len(t) > 1 or t in ("i", "a")):
                    found.append(forms.get(t, t))
        return found

    def reduce(texts: pa.Array) -> pa.Array:
        lists = pc.utf8_split_whitespace(texts)
        words_of = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        encoded = lists.flatten().dictionary_encode()
        made = [of_word(w) for w in encoded.dictionary.to_pylist()]
        sizes = np.array([len(m) for m in made], np.int64)
        starts = np.cumsum(sizes) - sizes
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        ends = np.cumsum(each)
        place = np.repeat(starts[codes] - (ends - each), each) + np.arange(each.sum())
        flat = pa.array([t for m in made for t in m], pa.string()).take(pa.array(place))
        rows = np.append(0, ends)[np.append(0, np.cumsum(words_of))]
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), flat)

    return F.arrow_udf(reduce, "array<string>")(plain)


def cluster_tokens(text: str = "commenttext") -> Column:
    """The `tokens` that `cluster_preprocess` adds by default."""
    return reduced_tokens(T.plain_text_cluster(F.col(text)))


def fit_terms(df: DataFrame) -> tfidf.TfidfModel:
    """TF-IDF over 1- and 2-grams of the rows that have tokens."""
    return tfidf.fit(df, "tokens", sizes=tfidf.SIZES)


def add_vectors(df: DataFrame, model: tfidf.TfidfModel, output: str = "features") -> DataFrame:
    return model.transform(df, "tokens", output, tfidf.SIZES)


def kept_terms(df: DataFrame, model: tfidf.TfidfModel) -> DataFrame:
    """Terms whose boosted mean weight over the non-empty rows reaches the minimum."""
    full = df.where(F.size("tokens") > 0)
    return tfidf.corpus_term_scores(full, model, T.boost_terms, totals=model.totals(full, "tokens", tfidf.SIZES))


def vocab_filter(df: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Keep only tokens among the kept terms (at most `max_features` of them); a row left without
    any reads `<empty>`."""
    allowed = list(kept) or [EMPTY]
    filtered = df.withColumn("tokens", F.filter("tokens", lambda t: t.isin(allowed)))
    joined = F.array_join("tokens", " ")
    return filtered.withColumn("textcleaned", F.when(joined == "", EMPTY).otherwise(joined))


def valid_row() -> Column:
    return ~T.too_short(F.col("textcleaned")) & (F.col("textcleaned") != EMPTY)


# ---- k-means -----------------------------------------------------------------------------------


def distinct_texts(valid: DataFrame, model: tfidf.TfidfModel) -> DataFrame:
    """Each distinct cleaned text once, with its vector and its number of rows as `weight`.

    Equal comments have equal vectors, so k-means over these weighted rows has the same cost function
    as over all rows; its many passes then skip the copies, however often a text was posted.
    """
    texts = valid.groupBy("textcleaned").agg(F.count("*").cast("double").alias("weight"))
    return add_vectors(texts.withColumn("tokens", F.split("textcleaned", " ")), model)


def centroids(df: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """(cluster, centre) as arrays; one mergeable buffer per cluster, so a large cluster is summed
    up in parts."""
    return df.groupBy(cluster).agg(
        vector_to_array(Summarizer.mean(F.col(features))).alias("centre")
    )


def squared_norm(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x * x)


def squared_distance(vector: Column, centre: Column, norm: Column) -> Column:
    """Squared Euclidean distance of a sparse or dense vector to a dense array with the squared length `norm`."""
    pairs = F.arrays_zip(tfidf.indices(vector).alias("i"), tfidf.values(vector).alias("v"))
    return F.greatest(norm + F.aggregate(
        pairs, F.lit(0.0),
        lambda acc, e: acc + e["v"] * (e["v"] - 2 * F.get(centre, e["i"])),
    ), F.lit(0.0))


def _nearest(features: str, listed: Column) -> Column:
    """The cluster of the nearest of an array of (cluster, centre, norm); the lowest id wins a tie."""
    nearest = F.array_min(F.transform(listed, lambda c: F.struct(
        F.round(squared_distance(F.col(features), c["centre"], c["norm"]), 9).alias("d"), c["cluster"].alias("cluster"))))
    return nearest["cluster"]


def kmeans_assign(df: DataFrame, centres: DataFrame, features: str = "features") -> DataFrame:
    """Add `cluster`, the nearest of the given (cluster, centre) rows; the lowest id wins a tie.

    The centres are a model of a few rows; they reach the rows as one array from a scalar subquery,
    so there is no join and every row meets its k centres in place.
    """
    row = F.struct("cluster", "centre", squared_norm(F.col("centre")).alias("norm"))
    listed = centres.agg(F.array_sort(F.collect_list(row)).alias("c"))
    found = df.withColumn("_centres", listed.scalar())
    return found.withColumn("cluster", _nearest(features, F.col("_centres"))).drop("_centres")


def silhouette(
    df: DataFrame, cluster: str = "cluster", features: str = "features", weight: str | None = None
) -> float:
    """Mean silhouette with squared Euclidean distances over all rows. That distance needs only sums
    per cluster, not pairs of rows, so nothing is sampled."""
    evaluator = ClusteringEvaluator(predictionCol=cluster, featuresCol=features)
    return (evaluator.setWeightCol(weight) if weight else evaluator).evaluate(df)


def fit_kmeans(
    df: DataFrame, ks: Sequence[int], key: str, features: str = "features", weight: str | None = None,
    seed: int = SEED, restarts: int = RESTARTS,
) -> dict[int, kmeans.Clusters]:
    """For each k the best of several k-means runs by training cost; all of them share each scan (see `kmeans`)."""
    found = cut_lineage(kmeans.points(df, key, features, weight))
    models = kmeans.best_per_k(kmeans.fit_all(found, ks, restarts, seed))
    discard(found)
    return models


def choose_k(
    df: DataFrame, key: str, max_k: int = MAX_K, features: str = "features", weight: str | None = None,
    n_rows: int | None = None, seed: int = SEED, restarts: int = RESTARTS,
) -> tuple[list[tuple[int, float, bool]], kmeans.Clusters | None]:
    """Silhouette of k = 2 up to `max_k` (k, score, chosen) and the best model.

    `n_rows` counts all rows, also those that are not clustered; half of it bounds k. A k with fewer
    rows, or fewer than two clusters found, scores -1; the first best k is chosen.
    """
    found = cut_lineage(kmeans.points(df, key, features, weight))
    n = found.agg(F.sum("w")).first()[0] or 0
    ks = range(2, min(max_k, max(2, int(n if n_rows is None else n_rows) // 2)) + 1)
    models = kmeans.best_per_k(kmeans.fit_all(found, [k for k in ks if n >= k], restarts, seed))
    scores = dict.fromkeys(ks, -1.0) | kmeans.silhouettes(found, models)
    discard(found)
    best = max(ks, key=lambda k: round(scores[k], 9))
    return [(k, scores[k], k == best) for k in ks], models.get(best)


def centre_rows(spark: SparkSession, model: kmeans.Clusters) -> DataFrame:
    """(cluster, centre) of a fitted model, as `kmeans_assign` takes them."""
    rows = [(i, c.tolist()) for i, c in enumerate(model.centres)]
    return spark.createDataFrame(rows, "cluster int, centre array<double>")


# ---- describing clusters -----------------------------------------------------------------------


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("size"))


def cluster_top_terms(
    df: DataFrame, model: tfidf.TfidfModel, cluster: str = "cluster", n: int = 10
) -> DataFrame:
    """The n terms with the highest mean weight in each cluster, positive ones only."""
    sizes = broadcast_checked(cluster_sizes(df, cluster))
    means = (
        tfidf.entries(df, [cluster]).groupBy(cluster, "index").agg(F.sum("weight").alias("total"))
        .join(sizes, cluster).withColumn("score", F.col("total") / F.col("size"))
        .join(F.broadcast(model.names(df.sparkSession)), "index")
    )
    order = W.partitionBy(cluster).orderBy(F.round("score", 9).desc(), "term")
    ranked = means.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select(cluster, "rank", "term", "score")


def cluster_representatives(
    df: DataFrame, row_id: str, cluster: str = "cluster", features: str = "features",
    n: int = REPRESENTATIVES,
) -> DataFrame:
    """The n rows nearest to the mean of their cluster. Each task keeps its own n best rows of a
    cluster before anything is shuffled (window group limit)."""
    rows = df.where(F.col(cluster).isNotNull())
    centres = centroids(rows, cluster, features).withColumn("_norm", squared_norm(F.col("centre")))
    distance = F.sqrt(squared_distance(F.col(features), F.col("centre"), F.col("_norm")))
    measured = rows.join(broadcast_checked(centres), cluster).withColumn("distance", distance).drop("centre", "_norm")
    order = W.partitionBy(cluster).orderBy(F.round("distance", 9), row_id)
    return measured.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _phrase_candidates(df: DataFrame, model: tfidf.TfidfModel, cluster: str) -> DataFrame:
    """(cluster, phrase, relevance, at, weights): all 1- and 2-grams of a cluster's tokens, each with its vector and the
    cosine of that with the cluster's mean; stored."""
    rows = df.where(F.col(cluster).isNotNull())
    centres = broadcast_checked(centroids(rows, cluster))
    found = F.explode(F.array_distinct(tfidf.ngrams(F.col("tokens")))).alias("phrase")
    phrases = cut_lineage(rows.select(cluster, found).distinct(), heavy=True).withColumn(
        "_tokens", F.split("phrase", " ")
    )
    centre, vector = F.col("centre"), F.col("vector")
    length = F.sqrt(F.aggregate(centre, F.lit(0.0), lambda acc, x: acc + x * x))
    pairs = F.arrays_zip(tfidf.indices(vector).alias("i"), tfidf.values(vector).alias("v"))
    product = F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + e["v"] * F.get(centre, e["i"]))
    return cut_lineage(
        model.transform(phrases, "_tokens", "vector", tfidf.SIZES).join(centres, cluster)
        .withColumn("relevance", F.coalesce(F.try_divide(product, length), F.lit(0.0)))
        .select(cluster, "phrase", "relevance", tfidf.indices(vector).alias("at"),
                tfidf.values(vector).alias("weights"))
    )


def _similarity(p: Column) -> Column:
    """Product of a row's vector with that of a picked phrase."""
    mine = F.arrays_zip(F.col("at"), F.col("weights"))
    return F.aggregate(mine, F.lit(0.0), lambda acc, e: acc + e["weights"] * F.coalesce(
        F.get(p["weights"], F.array_position(p["at"], e["at"]).cast("int") - 1), F.lit(0.0)
    ))


def cluster_keyphrases(
    df: DataFrame, model: tfidf.TfidfModel, cluster: str = "cluster", n: int = 10,
    diversity: float = 0.5, scored_per_round: list[int] | None = None,
) -> DataFrame:
    """Keyphrases (cluster, rank, phrase, relevance) by maximal marginal relevance, chosen lazily.

    A phrase's margin, its relevance less its likeness to what was picked, can only fall as more is picked, so the last
    one computed is an upper bound. Each round scores the phrase with the highest bound of its cluster; then only
    phrases whose bound is not below that margin can win and are scored. Phrases that were never near are not looked
    at again: `active` holds the others, with their bounds. No cluster's candidates are gathered in one task and
    none are left out. `scored_per_round` receives the number of phrases scored in each round.
    """
    relevance = F.round((1 - diversity) * F.col("relevance"), 9)
    base = _phrase_candidates(df, model, cluster).withColumn("bound", relevance)
    columns = ["phrase", "relevance", "at", "weights"]
    best = F.min(F.struct("order", *columns))
    first = base.withColumn("order", -F.round("relevance", 9)).groupBy(cluster).agg(F.array(best).alias("picked"))
    picks = cut_lineage(first.withColumn("limit", F.lit(float("inf"))))
    active = base.limit(0)
    taken = F.exists("picked", lambda p: p["phrase"] == F.col("phrase"))

    def with_margin(rows: DataFrame) -> DataFrame:
        overlap = F.array_max(F.transform("picked", _similarity))
        margin = (1 - diversity) * F.col("relevance") - diversity * overlap
        return rows.withColumn("bound", F.round(margin, 9))

    for _ in range(n - 1):
        known = broadcast_checked(picks)
        held = active.join(known, cluster).where(~taken)
        fresh = base.join(known, cluster).where((F.col("bound") < F.col("limit")) & ~taken)
        leaders = held.unionByName(fresh).groupBy(cluster).agg(
            F.max_by(F.struct(*columns), F.struct("bound", "phrase")).alias("leader"), F.first("picked").alias("picked"))
        least = with_margin(leaders.select(cluster, "leader.*", "picked")).select(cluster, F.col("bound").alias("least"))
        least = broadcast_checked(least)
        held, fresh = held.join(least, cluster), fresh.join(least, cluster).where(F.col("bound") >= F.col("least"))
        near = held.where(F.col("bound") >= F.col("least")).unionByName(fresh)
        scored = with_margin(near).withColumn("scored", F.lit(True))
        far = held.where(F.col("bound") < F.col("least")).withColumn("scored", F.lit(False))
        kept = cut_lineage(scored.unionByName(far).select(cluster, *columns, "bound", "scored"))
        chosen = kept.where("scored").withColumn("order", -F.col("bound")).groupBy(cluster).agg(best.alias("best"))
        if scored_per_round is not None:
            scored_per_round.append(kept.where("scored").count())
        active = kept.drop("scored")
        grown = picks.join(chosen, cluster, "left").join(least, cluster, "left")
        picks = cut_lineage(grown.select(
            cluster, F.concat("picked", F.array_compact(F.array("best"))).alias("picked"),
            F.least("limit", "least").alias("limit")))
    return picks.select(cluster, F.posexplode("picked").alias("pos", "p")).select(
        cluster, (F.col("pos") + 1).alias("rank"), "p.phrase", "p.relevance"
    )


def prototype_vectors(model: tfidf.TfidfModel, prototypes: Mapping[str, Sequence[str]] = PROTOTYPES) -> dict[str, list[float]]:
    """The unit-length TF-IDF vector of each category's words; all zeros if the vocabulary has none of them."""
    place, found = {t: i for i, t in enumerate(model.terms)}, {}
    for name, listed in prototypes.items():
        vector = [0.0] * len(model.terms)
        for i in sorted({place[t] for t in listed if t in place}):
            vector[i] = model.idf[i]
        norm = math.sqrt(sum(x * x for x in vector))
        found[name] = [x / norm for x in vector] if norm else vector
    return found


def _constant(numbers: Sequence[float]) -> Column:
    """An array of numbers as one literal, which Spark folds when it plans."""
    return F.from_json(F.lit(json.dumps(list(numbers))), "array<double>")


def label_clusters(
    representatives: DataFrame, model: tfidf.TfidfModel, cluster: str = "cluster", features: str = "features",
    prototypes: Mapping[str, Sequence[str]] = PROTOTYPES,
) -> DataFrame:
    """(cluster, category): the category whose words have the highest cosine with the representatives' vectors taken
    together; `others` if no cosine is above 0. The first category wins a tie.

    The sum of the representatives has the same length for every category, so the order of the cosines is that of
    the products with the unit-length prototypes, which add up per cluster.
    """
    vectors = prototype_vectors(model, prototypes)
    entries = F.arrays_zip(tfidf.indices(F.col(features)).alias("i"), tfidf.values(F.col(features)).alias("v"))

    def product(vector: list[float]) -> Column:
        dense = _constant(vector)
        return F.sum(F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["v"] * F.get(dense, e["i"])))

    scored = representatives.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(*[
        F.round(product(v), 9).alias(f"score_{i}") for i, v in enumerate(vectors.values())
    ])
    best = F.greatest(*[F.col(f"score_{i}") for i in range(len(vectors))])
    ladder = F.when(best <= 0, OTHERS)
    for i, name in enumerate(vectors):
        ladder = ladder.when(F.col(f"score_{i}") == best, name)
    return scored.select(cluster, ladder.otherwise(OTHERS).alias("category"))


def cluster_profile(
    df: DataFrame, model: tfidf.TfidfModel, row_id: str, cluster: str = "cluster", text: str = "textcleaned",
    n: int = 10, phrases: bool = True,
) -> DataFrame:
    """What a cluster is about, one row each: size, top_terms, representatives (their ids, nearest first), their texts
    as samples, and keyphrases (without `phrases`: none)."""

    def listed(rows: DataFrame, value: str, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("rank", value)))
        return rows.groupBy(cluster).agg(F.transform(ordered, lambda x: x[value]).alias(name))

    stored = cut_lineage(cluster_representatives(df, row_id, cluster).select(cluster, "rank", row_id, text))
    parts = [
        listed(cluster_top_terms(df, model, cluster, n), "term", "top_terms"),
        listed(stored, row_id, "representatives"), listed(stored, text, "samples"),
    ]
    if phrases:
        parts.append(listed(cluster_keyphrases(df, model, cluster, n), "phrase", "keyphrases"))
    found = cluster_sizes(df, cluster)
    for part in parts:
        found = found.join(part, cluster, "left")
    return found


def apply_cluster_label(df: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Add `cluster_label`: the category of the row's cluster, `others` without one."""
    joined = df.join(broadcast_checked(labels), cluster, "left")
    return joined.withColumn("cluster_label", F.coalesce("category", F.lit(OTHERS))).drop("category")


# ---- the fitted model --------------------------------------------------------------------------


@dataclass
class ClusterModel:
    """All that assigning a category to a comment needs: vocabulary with idf, kept terms, and the centres with
    their categories. At most `max_features` terms and `max_k` centres, so it is small whatever it was fitted on."""

    vocabulary: tfidf.TfidfModel
    kept: list[str]
    centres: list[list[float]]
    categories: list[str]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """`terms` (index, term, idf, kept) and `centres` (cluster, category, centre)."""
        kept = set(self.kept)
        terms = [(i, t, w, t in kept) for i, (t, w) in enumerate(zip(self.vocabulary.terms, self.vocabulary.idf))]
        centres = [(i, c, v) for i, (c, v) in enumerate(zip(self.categories, self.centres))]
        return {
            "terms": spark.createDataFrame(terms, "index int, term string, idf double, kept boolean"),
            "centres": spark.createDataFrame(centres, "cluster int, category string, centre array<double>"),
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the tables as Parquet under `path`; a model that is there is replaced."""
        for name, df in self.tables(spark).items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ClusterModel":
        terms = spark.read.parquet(f"{path}/terms").orderBy("index").collect()
        centres = spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()
        return cls(
            tfidf.TfidfModel([r["term"] for r in terms], [r["idf"] for r in terms]), sorted(r["term"] for r in terms if r["kept"]),
            [r["centre"] for r in centres], [r["category"] for r in centres],
        )

    def vectors(self, tokens: DataFrame) -> DataFrame:
        """`tokens` reduced to the kept terms, with `features`."""
        return add_vectors(vocab_filter(tokens, self.kept), self.vocabulary)

    def assign(self, vectors: DataFrame, output: str = "cluster") -> DataFrame:
        """Add the nearest centre of rows with `features`; null for rows that are not clustered."""
        nearest = kmeans.nearest(F.col("features"), np.array(self.centres))
        return vectors.withColumn(output, F.when(valid_row(), nearest))

    def apply(self, df: DataFrame, text: str = "commenttext") -> DataFrame:
        """Add `cluster_label` to every row, in place: no join, no shuffle, batch or stream. Texts that are not
        clustered get `others`; so does every text if nothing could be fitted."""
        if not self.centres:
            return df.withColumn("cluster_label", F.lit(OTHERS))
        return self.label(cluster_preprocess(df, text), df.columns)

    def label(self, tokens: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns `keep` of rows with `tokens` and `textcleaned`, and `cluster_label` in place of one that is there."""
        kept = [c for c in keep if c != "cluster_label"]
        if not self.centres:
            return tokens.select(*kept, F.lit(OTHERS).alias("cluster_label"))
        found = self.assign(self.vectors(tokens), "_cluster")
        names = F.array(*[F.lit(c) for c in self.categories])
        return found.select(*kept, F.coalesce(F.get(names, F.col("_cluster")), F.lit(OTHERS)).alias("cluster_label"))


def fit_clusters(
    df: DataFrame, text: str = "commenttext", row_id: str = "commentid", max_k: int = MAX_K, restarts: int = RESTARTS,
) -> ClusterModel:
    """`fit_tokens` over the tokens of the texts, which are stored once for all passes."""
    tokens = cut_lineage(
        cluster_preprocess(df.select(row_id, text), text).select(row_id, "tokens", "textcleaned")
    )
    model = fit_tokens(tokens, row_id, max_k, restarts)
    discard(tokens)
    return model


def fit_tokens(
    tokens: DataFrame, row_id: str = "commentid", max_k: int = MAX_K, restarts: int = RESTARTS,
) -> ClusterModel:
    """Fit vocabulary, kept terms, k-means over the distinct valid texts for the best k, and a category per cluster
    from the rows nearest to its mean. `tokens` (row_id, tokens, textcleaned) is read by all passes and should be stored."""
    vocabulary = fit_terms(tokens)
    if not vocabulary.terms:
        return ClusterModel(vocabulary, [], [], [])
    model = ClusterModel(
        vocabulary, [r["term"] for r in kept_terms(tokens, vocabulary).select("term").orderBy("term").collect()], [], [])
    valid = cut_lineage(model.vectors(tokens).where(valid_row()).select(row_id, "textcleaned", "features"))
    texts = distinct_texts(valid, vocabulary)
    _, best = choose_k(texts, "textcleaned", max_k, weight="weight", n_rows=tokens.count(), restarts=restarts)
    if best is None:
        discard(valid)
        return model
    model.centres = best.centres.tolist()
    assigned = cut_lineage(model.assign(valid))
    discard(valid)
    found = dict(label_clusters(cluster_representatives(assigned, row_id), vocabulary).collect())  # at most max_k rows
    discard(assigned)
    model.categories = [found.get(i, OTHERS) for i in range(len(model.centres))]
    return model


def product_clusters(
    df: DataFrame, text: str = "commenttext", row_id: str = "commentid", max_k: int = MAX_K,
    restarts: int = RESTARTS,
) -> DataFrame:
    """Add `cluster_label`, one of the category names or `others`, by a model fitted on the same rows; rows are
    kept 1:1."""
    return fit_clusters(df, text, row_id, max_k, restarts).apply(df, text)


def dense_features(df: DataFrame, array: str, output: str = "features") -> DataFrame:
    """Arrays of floats, such as precomputed embeddings, as vectors."""
    return df.withColumn(output, array_to_vector(F.col(array).cast("array<double>")))
