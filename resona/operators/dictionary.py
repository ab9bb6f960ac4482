"""Dictionaries as tables: word forms and abbreviations of any number, looked up by joins.

Only the distinct words of a row travel, so a word that stands a thousand times in a text meets the dictionary once; words
that stand in very many texts are hot keys of that join and are spread. What comes back to a row are the words that have
a form, and they are put in place there.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.plans.skew import ROWS_PER_TASK, salted_join

DEFAULT_POS = "n"  # noun: what a word without a tag counts as


def forms_by_token(forms: DataFrame, tags: DataFrame | None = None, default_pos: str = DEFAULT_POS) -> DataFrame:
    """(token, form) of a dictionary (token, form), or of one by part of speech (token, pos, form) with the usual part of
    speech of each word in `tags` (token, pos). Of several forms the least counts."""
    if "pos" in forms.columns:
        usual = F.lit(default_pos)
        if tags is not None:
            forms = forms.join(tags.groupBy("token").agg(F.min("pos").alias("_tag")), "token", "left")
            usual = F.coalesce("_tag", usual)
        forms = forms.where(F.col("pos") == usual)
    return forms.groupBy("token").agg(F.min("form").alias("form"))


def replace_tokens(
    df: DataFrame, row_id: str, forms: DataFrame, tokens: str = "tokens", tags: DataFrame | None = None,
    pos: str | None = None, default_pos: str = DEFAULT_POS, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """`df` with the array `tokens` of lower-case words replaced by their forms, in order; words without a form stay.

    A form of several words becomes several tokens. With `pos`, an array of parts of speech beside `tokens` from any
    tagger, a word is looked up by both; else by its usual part of speech (`forms_by_token`). Rows come back one for one
    and need a unique `row_id`; null and empty arrays stay as they are, null tokens go.
    """
    lowered = F.transform(F.col(tokens), lambda t: F.lower(t))
    if pos:
        keys = F.transform(lowered, lambda t, i: F.when(t.isNotNull(), F.concat_ws(
            "\u0000", t, F.coalesce(F.get(F.col(pos), i), F.lit(default_pos)))))
        table = forms.groupBy(F.concat_ws("\u0000", "token", "pos").alias("word")).agg(F.min("form").alias("form"))
    else:
        keys, table = lowered, forms_by_token(forms, tags, default_pos).withColumnRenamed("token", "word")
    words = df.select(F.col(row_id).alias("_row"), F.explode(F.array_distinct(keys)).alias("word")).where(
        F.col("word").isNotNull() & F.col("_row").isNotNull())
    met = salted_join(words, table.where("form is not null"), "word", "_row", rows_per_task=rows_per_task)
    listed = met.groupBy("_row").agg(F.collect_set(F.struct("word", "form")).alias("_forms"))
    joined = df.join(listed, F.col(row_id) == F.col("_row"), "left")
    replaced = _in_place(lowered, keys, F.col("_forms.word"), F.col("_forms.form"))
    has_words = F.col(row_id).isNotNull() & F.exists(F.col(tokens), lambda t: t.isNotNull())
    return joined.withColumn(tokens, F.when(has_words, replaced).otherwise(F.col(tokens))).drop("_row", "_forms")


def _in_place(tokens: Column, keys: Column, words: Column, forms: Column) -> Column:
    """Each token with the form of its key among the row's `words`, in Arrow batches; others stay, null ones go. What holds
    spaces becomes several tokens."""

    def numbered(lists: pa.ListArray) -> np.ndarray:
        return np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))

    def replace(tokens: pa.Array, keys: pa.Array, words: pa.Array, forms: pa.Array) -> pa.Array:
        rows, known = numbered(tokens), numbered(words)
        own, flat = tokens.flatten(), keys.flatten()
        codes = pa.concat_arrays([flat, words.flatten()]).dictionary_encode(null_encoding="encode")
        n, codes = max(len(codes.dictionary), 1), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.index_in(pa.array(rows * n + codes[:len(rows)]), value_set=pa.array(known * n + codes[len(rows):]))
        found = pc.coalesce(forms.flatten().take(place), own)
        there = pc.is_valid(own)
        pieces = pc.split_pattern(found.filter(there), " ")
        counts = np.bincount(
            rows[there.to_numpy(zero_copy_only=False)], pieces.value_lengths().to_numpy(zero_copy_only=False), len(tokens))
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pieces.flatten())

    return F.arrow_udf(replace, "array<string>")(tokens, keys, words, forms)
