"""Embedding: token windows, window vectors, mean pooling, zero fallback.

The reference encodes code with a pretrained model: token ids -> windows of at most 512
tokens with stride 256 -> the first-position hidden state of each window -> the mean
over windows (a zero vector when there is no window). The model is a plug-in point
(``model_encoder``). The built-in encoder needs no weights: a *hashed bag of tokens*.

* tokens: ``[A-Za-z_][A-Za-z0-9_]*``, ``[0-9]+`` or any other single non-space
  character, with ``<s>`` and ``</s>`` added at the ends (so an empty text has 2);
* a token goes to bucket ``int(md5(token)[6:8], 16)`` (the digest's fourth byte), 256
  buckets; a window's vector counts its tokens per bucket.

Mean pooling never materialises windows: token ``t`` lies in ``m(t)`` windows (1 or 2),
so the mean is ``sum(m(t) per bucket) / n_windows``. The work is one explode of tokens
and one aggregation keyed by (item, bucket); when the input is already hash-partitioned
by the item key (the function table is), the aggregation and the dense assembly run
without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from patchtrace.functions.text import NS
from patchtrace.functions.vectors import bucket_count_batches, pooled_bucket_batches, pooled_bucket_means

# Fixed values of the reference: window length, stride, smallest window kept.
WINDOW = 512
STRIDE = 256
MIN_WINDOW = 2
# Ours: the built-in encoder's tokens and dimension.
TOKEN_PATTERN = f"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|{NS}"
BOS, EOS = "<s>", "</s>"
DIM = 256


def tokens(text: Column, special: bool = True) -> Column:
    t = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)
    return F.concat(F.array(F.lit(BOS)), t, F.array(F.lit(EOS))) if special else t


def n_windows(n_tokens: Column) -> Column:
    """Windows kept for a sequence of L tokens: 0 if L < 2, 1 if L <= 512, else
    ceil((L - 512) / 256) + 1 (the loop stops at the first window reaching the end)."""
    return (F.when(n_tokens < MIN_WINDOW, F.lit(0))
             .when(n_tokens <= WINDOW, F.lit(1))
             .otherwise((F.ceil((n_tokens - WINDOW) / F.lit(STRIDE)) + 1).cast("int")))


def bucket(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 7, 2), 16, 10).cast("int")


def token_windows(items: DataFrame, key: list[str], text: str = "text", special: bool = True) -> DataFrame:
    """One row per window: key..., win_no, start, end (token offsets, end exclusive)."""
    t = items.select(*key, tokens(F.col(text), special).alias("_tok"))
    t = t.withColumn("_L", F.size("_tok")).withColumn("_n", n_windows(F.col("_L")))
    w = t.select(*key, "_L", "_tok",
                 F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1))
                            .otherwise(F.array().cast("array<int>"))).alias("win_no"))
    w = w.withColumn("start", F.col("win_no") * STRIDE).withColumn("end", F.least(F.col("start") + WINDOW, F.col("_L")))
    return w.select(*key, "win_no", "start", "end", F.slice("_tok", F.col("start") + 1, F.col("end") - F.col("start")).alias("tokens"))


def _dense(sparse: DataFrame, key: list[str], value: str, scale: str | None = None) -> DataFrame:
    """(key..., bucket, value) -> (key..., embedding array<double> of DIM), by a pivot
    on the known bucket values (one aggregation, no per-bucket lookups)."""
    den = F.col(scale).cast("double") if scale else F.lit(1.0)
    if scale:
        sparse = sparse.withColumn(value, F.col(value).cast("double") / den)
    wide = sparse.groupBy(*key).pivot("bucket", list(range(DIM))).agg(F.first(value))
    vec = F.array(*[F.coalesce(F.col(f"`{b}`").cast("double"), F.lit(0.0)) for b in range(DIM)])
    return wide.select(*key, vec.alias("embedding"))


def window_vectors(windows: DataFrame, key: list[str]) -> DataFrame:
    """The built-in encoder's vector per window (token counts per bucket).

    A token is the two hex digits of its bucket until its window's row is counted, so a task
    groups some hundred bytes a window, not a row a token and a column a bucket."""
    k = key + ["win_no"]
    digits = F.array_join(F.transform("tokens", lambda t: F.substring(F.md5(t), 7, 2)), "")
    held = (windows.where(F.size("tokens") > 0).select(*k, digits.alias("_b"))
            .groupBy(*k).agg(F.unhex(F.array_join(F.collect_list("_b"), "")).alias("_b")))
    schema = StructType([held.schema[c] for c in k] + [StructField("embedding", ArrayType(DoubleType()))])
    return held.mapInArrow(bucket_count_batches(k, "_b", DIM), schema)


def mean_pool(window_vecs: DataFrame, key: list[str]) -> DataFrame:
    """Unweighted mean of the window vectors of each item, in their own dimension."""
    held = (window_vecs.where(F.size("embedding") > 0).groupBy(*key)
            .agg(F.collect_list(F.col("embedding").cast("array<double>")).alias("_v")))
    total = F.aggregate(F.slice("_v", F.lit(2), F.size("_v")), F.get("_v", F.lit(0)),
                        lambda acc, v: F.zip_with(acc, v, lambda a, x: F.coalesce(a + x, a, x)))
    return held.select(*key, F.transform(total, lambda x: x / F.size("_v")).alias("embedding"))


def embed_texts(items: DataFrame, key: list[str], text: str = "text", special: bool = True) -> DataFrame:
    """E1-E3 fused: the mean of the window vectors, without materialising windows.

    Map-only: tokens and their bucket ids are computed in the JVM, in the row; the
    multiplicity-weighted bucket counts of a whole Arrow batch are pooled by one numpy
    ``bincount``. No token row is shuffled. Items without any window get no row here;
    see ``with_zero_fallback``.
    """
    # the token array is referenced once (the window count is derived from its length
    # inside the pooling step), so the tokenizer regex runs once per row
    b = F.transform(tokens(F.col(text), special), lambda x: bucket(x))
    ids = items.select(*key, b.alias("_b"))
    schema = StructType([ids.schema[k] for k in key] + [StructField("embedding", ArrayType(DoubleType()))])
    return ids.mapInArrow(pooled_bucket_batches(key, "_b", DIM, WINDOW, STRIDE, MIN_WINDOW), schema)


def embed_texts_udf(items: DataFrame, key: list[str], text: str = "text", special: bool = True) -> DataFrame:
    """``embed_texts`` as a column expression (scalar pandas UDF), for use inside a
    ``select``; the same vectors, but one Python object per row on the way back."""
    pool = pooled_bucket_means(DIM, WINDOW, STRIDE, MIN_WINDOW)
    b = F.transform(tokens(F.col(text), special), lambda x: bucket(x))
    out = items.select(*key, pool(b).alias("embedding"))
    return out.where(F.col("embedding").isNotNull())


def embed_texts_exploded(items: DataFrame, key: list[str], text: str = "text", special: bool = True) -> DataFrame:
    """The same result as ``embed_texts`` with DataFrame operators only: one row per
    token, multiplicity from its position, aggregation by (item, bucket), pivot to a
    dense vector (kept as the built-in cross-check of the Arrow path)."""
    t = items.select(*key, tokens(F.col(text), special).alias("_tok"))
    t = t.withColumn("_n", n_windows(F.size("_tok"))).where(F.col("_n") > 0)
    e = t.select(*key, "_n", F.posexplode("_tok").alias("_p", "_t"))
    # windows holding token p: w with 256w <= p < 256w + 512 and w < n
    hi = F.least(F.floor(F.col("_p") / STRIDE), F.col("_n") - 1)
    lo = F.greatest(F.ceil((F.col("_p") - WINDOW + 1) / F.lit(STRIDE)), F.lit(0))
    e = e.withColumn("_m", (hi - lo + 1).cast("long"))
    sp = e.groupBy(*key, bucket(F.col("_t")).alias("bucket")).agg(F.sum("_m").alias("n"), F.first("_n").alias("_nw"))
    return _dense(sp, key, "n", "_nw")


def with_zero_fallback(items: DataFrame, vectors: DataFrame, key: list[str], dim: int = DIM) -> DataFrame:
    """Every item gets a vector; items without a window get zeros(dim)."""
    z = F.array_repeat(F.lit(0.0).cast("double"), dim)
    return (items.select(*key).join(vectors, key, "left")
                 .withColumn("embedding", F.coalesce(F.col("embedding"), z)))


def model_encoder(make_encode, batch_size: int = 64):
    """E2 with a model: ``make_encode()`` runs once per Python worker and returns
    ``encode(texts: numpy array of str) -> numpy (n, dim)``, a text being a window's tokens
    joined by blanks. Window rows go through ``predict_batch_udf``; the vectors keep the
    model's own dimension. The result maps windows to windows with ``embedding``."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_encode, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=None)

    def encode(windows: DataFrame) -> DataFrame:
        return windows.withColumn("embedding", udf(F.array_join("tokens", " ")))

    return encode


def window_encoder(encode):
    """An item encoder ``(items, key) -> (key..., embedding)`` made of a window encoder:
    windows, their vectors, the mean per item (E1-E3)."""
    def run(items: DataFrame, key: list[str]) -> DataFrame:
        return mean_pool(encode(token_windows(items, key)), key)
    return run
