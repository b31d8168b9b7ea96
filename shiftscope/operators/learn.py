"""Supervised jobs: late delivery, text sentiment and remaining useful life, with their features and scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.types import StructField, StructType

from shiftscope.functions.numbers import days_between, ratio
from shiftscope.functions.ordered import halo_blocks, positions, running_sums
from shiftscope.functions.quantiles import exact_quantile
from shiftscope.operators.boosting import boost
from shiftscope.session import cut_lineage, dealt, scratch_path
from shiftscope.sources.tables import Shop

# ---------------------------------------------------------------- late delivery
NUMERIC = ["promised_days", "same_state", "order_value", "freight", "n_items", "n_sellers", "max_weight_g", "month", "weekday"]
CATEGORICAL = ["customer_state", "seller_state", "category"]
RARE = 50
LEVELS = 512  # codes of a category in boosted trees, at most


def late_features(shop: Shop) -> DataFrame:
    """What is known at purchase time, one row per delivered order and seller state, repeats removed.

    Items are dealt by order once, those of other orders go, and the rest is reduced per (order, seller state) before it meets the orders.
    """
    bought, promised, arrived = (F.col(f"order_{c}") for c in ("purchase_timestamp", "estimated_delivery_date", "delivered_customer_date"))
    orders = shop.orders.where((F.col("order_status") == "delivered") & arrived.isNotNull()).select(
        "order_id", "customer_id", bought.alias("purchased_at"), (arrived > promised).cast("int").alias("late"),
        days_between(bought, promised).alias("promised_days"),
    )
    lines = dealt(shop.order_items.select("order_id", "seller_id", "product_id", "price", "freight_value"), "order_id")
    items = (
        lines.join(orders.select("order_id"), "order_id", "left_semi")
        .join(shop.sellers.select("seller_id", "seller_state"), "seller_id")
        .join(shop.products.select("product_id", "product_category_name", "product_weight_g"), "product_id")
        .groupBy("order_id", "seller_state", "seller_id")
        .agg(F.sum("price").alias("price"), F.sum("freight_value").alias("freight"), F.count("*").alias("n"),
             F.max("product_weight_g").alias("weight"), F.max(F.coalesce("product_category_name", F.lit("unknown"))).alias("category"))
        .groupBy("order_id", "seller_state")
        .agg(F.sum("price").alias("order_value"), F.sum("freight").alias("freight"), F.sum("n").alias("n_items"),
             F.count("*").alias("n_sellers"), F.max("weight").alias("max_weight_g"), F.max("category").alias("category"))
    )
    rows = orders.join(shop.customers.select("customer_id", "customer_state"), "customer_id").join(items, "order_id")
    rows = rows.withColumn("same_state", (F.col("customer_state") == F.col("seller_state")).cast("int"))
    # rows are as many as items at most; equal ones meet by two of their columns
    rows = dealt(rows.drop("order_id", "customer_id"), "purchased_at", "order_value", of=shop.order_items).dropDuplicates()
    return rows.withColumns(
        {"month": F.month("purchased_at"), "weekday": F.weekday("purchased_at"), "freight_ratio": ratio(F.col("freight"), F.col("order_value"))}
    )


def fill_median(df: DataFrame, col: str) -> DataFrame:
    """Replace NULLs by the exact median of a column. ``df`` is written once, so its joins don't run again for the median."""
    df = cut_lineage(df)
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(exact_quantile(df, col, 0.5)).cast("double")))


def time_split(df: DataFrame, ts: str, q: float = 0.8) -> DataFrame:
    """Add ``split``: 'train' before the q-quantile of time, 'test' from it on."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = exact_quantile(df.select(at.alias("at")), "at", q)
    return df.withColumn("split", F.when(at < F.lit(cut), "train").otherwise("test"))


def class_weights(df: DataFrame, label: str) -> list[float]:
    """n / (2 * class size) of the classes 0 and 1."""
    row = df.agg(F.count("*").alias("n"), F.sum(label).alias("pos")).first()
    n, pos = row["n"], row["pos"] or 0
    return [n / (2 * max(n - pos, 1)), n / (2 * max(pos, 1))]


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """The weight of its class for every row, so both classes count alike."""
    per = class_weights(df, label)
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(per[1])).otherwise(F.lit(per[0])))


def merge_rare(df: DataFrame, fit_on: DataFrame, cols: Sequence[str], minimum: int = RARE) -> DataFrame:
    """Levels seen fewer than ``minimum`` times in ``fit_on`` become '(rare)'. The others are written, so that Spark knows they are few and rows stay where they are."""
    for c in cols:
        common = cut_lineage(fit_on.groupBy(c).count().where(F.col("count") >= minimum).select(c, F.lit(True).alias("_common")))
        df = df.join(common, c, "left").withColumn(c, F.when(F.col("_common"), F.col(c)).otherwise("(rare)")).drop("_common")
    return df


def late_logistic(train: DataFrame) -> PipelineModel:
    """Scaled numbers and one-hot categories into a class-balanced logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    stages = [
        StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_i" for c in CATEGORICAL], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in CATEGORICAL], outputCols=[f"{c}_v" for c in CATEGORICAL]),
        VectorAssembler(inputCols=NUMERIC, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
        VectorAssembler(inputCols=["scaled", *[f"{c}_v" for c in CATEGORICAL]], outputCol="features"),
        LogisticRegression(labelCol="late", weightCol="weight", maxIter=100, regParam=1e-4),
    ]
    return Pipeline(stages=stages).fit(balanced_weights(train, "late"))


def late_boosted(train: DataFrame, trees: int = 300) -> PipelineModel:
    """Boosted trees over numbers and ordinal-coded categories; a category may have any number of levels.

    Levels are coded by falling frequency, and all beyond the first LEVELS - 1 share the last code.
    """
    from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler

    codes = ", ".join(f"least({c}_i, {LEVELS - 1}.0) as {c}_b" for c in CATEGORICAL)
    stages = [
        StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_i" for c in CATEGORICAL], handleInvalid="keep"),
        SQLTransformer(statement=f"select *, {codes} from __THIS__"),
        VectorAssembler(inputCols=[*NUMERIC, *[f"{c}_b" for c in CATEGORICAL]], outputCol="features"),
    ]
    coded = Pipeline(stages=stages).fit(train)
    model = boost(coded.transform(train), "late", class_weights(train, "late"), True, trees, step=0.05, bins=LEVELS)
    return PipelineModel([*coded.stages, model])


def scored(model: PipelineModel, df: DataFrame, label: str, *keep: str) -> DataFrame:
    """(label, score, kept columns) with score = probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*keep, F.col(label).alias("label"), vector_to_array("probability")[1].alias("score"))


def binary_metrics(scores: DataFrame, tie: str, top: float = 0.1) -> DataFrame:
    """ROC-AUC, average precision and the positive rate among the floor(n * top) highest scores.

    Rows are first counted per distinct score; ranks come from sliced running sums, never from one sorted task.
    """
    per_score = scores.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("pos"))
    sums = {"cum_n": F.col("n"), "cum_pos": F.col("pos")}
    run = running_sums(per_score, [], "score", sums, descending=True)
    neg = F.col("n") - F.col("pos")
    wins = neg * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2)
    total = run.agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("positives"), F.sum(wins).alias("wins"),
        F.sum(F.col("pos") * ratio(F.col("cum_pos"), F.col("cum_n"))).alias("precision_sum"),
    )
    total = total.select(
        "rows", "positives", ratio(F.col("wins"), F.col("positives") * (F.col("rows") - F.col("positives"))).alias("roc_auc"),
        ratio(F.col("precision_sum"), F.col("positives")).alias("average_precision"),
    )
    place = positions(scores, [], "score", [tie], descending=True)
    k = F.floor(total.select("rows").scalar() * F.lit(top))
    best = place.where(F.col("pos") <= k).agg(F.avg("label").alias("r")).select("r").scalar()
    return total.withColumn("top_positive_rate", best)


# ---------------------------------------------------------------- text sentiment
def review_text_set(reviews: DataFrame, title: str, message: str, score: str, *keep: str) -> DataFrame:
    """Trimmed 'title message' of reviews with a message of at least 3 characters; negative = score <= 2."""
    text = F.trim(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.col(message)))
    rows = reviews.where(F.col(message).isNotNull() & (F.length(F.trim(F.col(message))) >= 3))
    return rows.select(*keep, text.alias("text"), (F.col(score) <= 2).cast("int").alias("negative"))


def _plain_letters() -> tuple[str, str]:
    """Every lower-case letter that is one base letter with accents, and the base letters."""
    parts = ((chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x2000) if chr(c).islower())
    pairs = [(c, p[0]) for c, p in parts if len(p) > 1 and all(map(unicodedata.combining, p[1:]))]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()
WORD_MIN_DF, CHAR_MIN_DF = 3, 5


def _fold(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}+", "")


def words_of(text: Column) -> Column:
    """Words of at least two characters."""
    return F.regexp_extract_all(_fold(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def padded_words(text: Column) -> Column:
    """What white space parts; character runs are taken inside these, with a blank before and after."""
    return F.filter(F.split(F.trim(_fold(text)), r"\s+"), lambda w: F.length(w) > 0)


# a kind of term: its words in SQL, the texts a term must occur in
KINDS = {"w": (words_of, WORD_MIN_DF), "c": (padded_words, CHAR_MIN_DF)}
TEXT_BLOCK = 2 << 20  # characters of a block of texts
LONG_WORD = 64  # longer words are cut one by one


def text_blocks(docs: DataFrame, key: str, text: str, kinds: Sequence[str], fit: Column | None = None, keep: Sequence[str] = (), chars: int = TEXT_BLOCK) -> DataFrame:
    """(block, key, kept, fitted, words of every kind): one row a key, dealt by hash to blocks of about ``chars`` characters.

    Texts move once. ``kept`` and ``fitted`` list the columns ``keep`` and ``fit`` of the rows of a key, which may be several.
    """
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = max(1, -(-size // chars))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), key, F.struct(
        F.coalesce(F.col(text), F.lit("")).alias("text"), (F.lit(True) if fit is None else fit).alias("fit"), F.struct(F.lit(0).alias("_"), *keep).alias("keep")).alias("r"))
    whole = rows.repartition(blocks, "block").groupBy("block", key).agg(F.collect_list("r").alias("r"))
    return whole.select("block", key, F.col("r.keep").alias("kept"), F.col("r.fit").alias("fitted"),
                        *[F.transform("r.text", KINDS[kind][0]).alias(kind) for kind in kinds])


def _counts(cell: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct cells, sum of their times)."""
    bits = int(times.max(initial=0)).bit_length()
    cell = np.sort((cell << bits) | times)  # one sort of numbers carries both
    first = np.flatnonzero(np.diff(cell >> bits, prepend=-1))
    return cell[first] >> bits, np.add.reduceat(cell & ((1 << bits) - 1), first) if len(first) else first


def _runs(words: pa.StringArray, low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, term of every run, runs of each word): character runs of the blank-padded words, word by word."""
    padded = pc.binary_join_element_wise("", words, "", " ")
    length = pc.utf8_length(padded).to_numpy().astype(np.int64)
    per = [np.maximum(length - n + 1, 0) for n in range(low, high + 1)]
    sizes = np.sum(per, axis=0)
    start, parts, places = np.cumsum(sizes) - sizes, [], []
    usual = np.flatnonzero(length <= LONG_WORD)
    for n, count in zip(range(low, high + 1), per):
        for i in range(int(count[usual].max(initial=0))):
            at = usual[count[usual] > i]
            parts.append(pc.utf8_slice_codeunits(padded.take(pa.array(at)), i, i + n))
            places.append(start[at] + i)
        start = start + count
    first = np.cumsum(sizes) - sizes
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        w = padded[k].as_py()
        parts.append(pa.array([w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)], pa.string()))
        places.append(first[k] + np.arange(sizes[k]))
    coded = pa.concat_arrays([*parts, pa.array([], pa.string())]).dictionary_encode()
    run = np.empty(int(sizes.sum()), np.int64)
    run[np.concatenate([*places, np.zeros(0, np.int64)])] = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, run, sizes


def block_terms(words: pa.ListArray, owner: np.ndarray, kind: str, low: int = 3, high: int = 5) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, term, tf) of texts' words: the words and neighbouring pairs ("w"), or the character runs inside words ("c").

    ``owner`` is the row of every text.
    """
    text = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    word, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    size, row = max(1, len(names)), owner[text]
    if kind == "w":
        near = np.flatnonzero(text[1:] == text[:-1])
        pair, back = np.unique(word[near] * size + word[near + 1], return_inverse=True)
        both = pc.binary_join_element_wise(names.take(pa.array(pair // size)), names.take(pa.array(pair % size)), " ")
        terms = pa.concat_arrays([names, both])
        row, term = np.concatenate([row, row[near]]), np.concatenate([word, len(names) + back])
        times = np.ones(len(row), np.int64)
    else:
        # equal words of a row are cut once
        cell, times = _counts(row * size + word, np.ones(len(row), np.int64))
        terms, run, sizes = _runs(names, low, high)
        row, word = cell // size, cell % size
        first, count = (np.cumsum(sizes) - sizes)[word], sizes[word]
        term = run[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        row, times = np.repeat(row, count), np.repeat(times, count)
    size = max(1, len(terms))
    cell, tf = _counts(row * size + term, times)
    return terms, cell // size, cell % size, tf


def _texts_of(table: pa.Table, kind: str) -> tuple[pa.ListArray, np.ndarray]:
    """(words of every text, the row it belongs to)."""
    texts = table[kind].combine_chunks()
    return texts.flatten(), np.repeat(np.arange(len(texts)), np.diff(texts.offsets.to_numpy()))


def _asked(blocks: DataFrame, kinds: Sequence[str], fitted_only: bool) -> DataFrame:
    """(block, kind, term, n): terms of a block and how many of its keys have them in fitted texts."""

    def count(key, table):
        out = []
        for kind in kinds:
            texts, owner = _texts_of(table, kind)
            fit = table["fitted"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool)
            # the texts of a row that count and the others are rows apart
            terms, row, term, _ = block_terms(texts, 2 * owner + fit, kind)
            n = np.bincount(term[row % 2 == 1], minlength=len(terms))
            if fitted_only:
                terms, n = terms.filter(pa.array(n > 0)), n[n > 0]
            out.append(pa.table([pa.array(np.full(len(terms), int(key[0].as_py()), np.int32)), pa.array([kind] * len(terms), pa.string()), terms, pa.array(n)], ["block", "kind", "term", "n"]))
        return pa.concat_tables(out)

    return blocks.select("block", "fitted", *kinds).groupBy("block").applyInArrow(count, "block int, kind string, term string, n bigint")


def term_idf(docs: DataFrame, key: str, text: str, kind: str, n_docs: Column | int, min_df: int) -> DataFrame:
    """(term, df, idf) with the smooth form ln((1 + n) / (1 + df)) + 1. Keys are counted in blocks of texts first."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    asked = _asked(text_blocks(docs, key, text, [kind]), [kind], True)
    counts = asked.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)
    return counts.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def text_weights(docs: DataFrame, key: str, text: str, kinds: Sequence[str] = ("w", "c"), fit: Column | None = None, keep: Sequence[str] = (), chars: int = TEXT_BLOCK, named: bool = True) -> DataFrame:
    """(key, kept, terms, weights): (1 + ln tf) * idf, each kind of a text scaled to length 1; statistics come from the rows ``fit`` (default: all).

    Texts are dealt to blocks. A block asks for the terms it has, each once, and gets back those with enough texts; texts and weights
    of single texts are never dealt by term, so no term is too frequent. Terms are marked "w:" or "c:", and null unless ``named``. Texts without terms are left out.
    """
    n = docs.where(F.lit(True) if fit is None else fit).agg(F.count("*").alias("n")).select("n").scalar()
    blocks = text_blocks(docs, key, text, kinds, fit, keep, chars)
    df = F.sum("n").over(Window.partitionBy("kind", "term"))  # a row for each block at most
    least = F.create_map(*[F.lit(x) for kind in kinds for x in (kind, KINDS[kind][1])])
    known = _asked(blocks, kinds, False).withColumn("df", df).where(F.col("df") >= least[F.col("kind")])
    known = known.select(F.col("block").alias("of_block"), "kind", "term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    kept = blocks.schema["kept"].dataType
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("kept", kept), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def weigh(table, known):
        parts = []
        for kind in kinds:
            (texts, owner), own = _texts_of(table, kind), known.filter(pc.equal(known["kind"], kind))
            terms, row, term, tf = block_terms(texts, owner, kind)
            place = pc.index_in(terms, own["term"].combine_chunks()).to_numpy(zero_copy_only=False)
            idf = np.append(own["idf"].to_numpy(), np.nan)[np.where(np.isnan(place), -1, place).astype(np.int64)] if len(terms) else np.zeros(0)
            use = ~np.isnan(idf[term]) if len(terms) else np.zeros(0, bool)
            row, term = row[use], term[use]
            raw = (1 + np.log(tf[use])) * idf[term]
            norm = np.sqrt(np.bincount(row, raw * raw, minlength=table.num_rows))
            names = pc.binary_join_element_wise(pa.scalar(f"{kind}:", pa.string()), terms, "").take(pa.array(term)) if named else pa.nulls(0, pa.string())
            parts.append((row, names, raw / norm[row]))
        row = np.concatenate([p[0] for p in parts])
        order = np.argsort(row, kind="stable")
        offsets = pa.array(np.searchsorted(row[order], np.arange(table.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, values.take(pa.array(order))) for values in (*([pa.concat_arrays([p[1] for p in parts])] if named else []), pa.array(np.concatenate([p[2] for p in parts])))]
        lists = lists if named else [pa.nulls(table.num_rows, pa.list_(pa.string())), *lists]
        out = pa.table([table[key].combine_chunks(), table["kept"].combine_chunks(), *lists], [key, "kept", "terms", "weights"])
        return out.filter(pa.array(np.diff(offsets.to_numpy()) > 0))

    return blocks.drop("fitted").groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(weigh, schema)


def hashed_vectors(weights: DataFrame, key: str, bits: int = 18) -> DataFrame:
    """(key, kept columns, features): sparse vectors with each term of ``text_weights`` at a hashed position, a row for each row of the texts.

    The cells of a vector column are written by SQL functions to the shared folder and read back as vectors, so nothing is shuffled.
    """
    from pyspark.ml.linalg import VectorUDT

    size = 1 << bits
    cells = F.sort_array(F.zip_with("terms", "weights", lambda t, w: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).cast("int").alias("i"), w.alias("w"))))

    def merge(c: Column) -> Column:
        """Cells of one position are added up."""
        # where a position begins, and behind the last cell
        first = lambda s: F.filter(s, lambda k: (k == 1) | (F.get(c, k - 1)["i"] != F.get(c, k - 2)["i"]))
        begins = F.transform(F.array(first(F.sequence(F.lit(1), F.size(c)))), lambda b: F.zip_with(
            b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(c) + 1)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))))[0]
        spans = F.filter(begins, lambda s: s["x"].isNotNull())
        total = lambda s: F.when(s["y"] == s["x"] + 1, F.get(c, s["x"] - 1)["w"]).otherwise(F.aggregate(F.slice(c, s["x"], s["y"] - s["x"]), F.lit(0.0), lambda a, v: a + v["w"]))
        return F.transform(spans, lambda s: F.struct(F.get(c, s["x"] - 1)["i"].alias("i"), total(s).alias("w")))

    packed = weights.select(key, "kept", F.transform(F.array(cells), merge)[0].alias("cells"))
    # the stored form of a sparse vector: kind 0, size, rising positions, values
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("cells.i").alias("indices"), F.col("cells.w").alias("values"))
    path = scratch_path(weights.sparkSession, "vectors")
    rows = packed.select(key, sparse.alias("features"), F.inline("kept")).drop("_")
    rows.write.parquet(path)
    schema = StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in rows.schema])
    return weights.sparkSession.read.schema(schema).parquet(path)


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2) -> DataFrame:
    """Add ``split`` so that each class gives exactly its share of rows to the test set, in hash order; rows of one key stay together.

    Only keys are put in order; the other columns stay where they are.
    """
    mixed = F.xxhash64(F.col(key).cast("string"))
    placed = positions(df.select(label, mixed.alias("_h"), key), [label], "_h", [key])
    size = df.groupBy(label).agg(F.count("*").alias("_n"))
    last = F.max(F.when(F.col("pos") <= F.round(F.col("_n") * test_share), F.struct("_h", key))).alias("_last")
    cuts = cut_lineage(placed.join(size, label).groupBy(label).agg(last))  # a row for each class
    test = F.col("_last").isNotNull() & (F.struct(mixed.alias("_h"), F.col(key)) <= F.col("_last"))
    return df.join(F.broadcast(cuts), label).withColumn("split", F.when(test, "test").otherwise("train")).drop("_last")


def sentiment_logistic(train: DataFrame, inverse_regularisation: float = 4.0) -> PipelineModel:
    """Class-balanced logistic regression on (features, negative)."""
    from pyspark.ml.classification import LogisticRegression

    # every round shuffles a gradient of all positions for each partition, so there are no more of these than cores can use
    rows = balanced_weights(train, "negative").coalesce(2 * train.sparkSession.sparkContext.defaultParallelism)
    n = rows.count()
    lr = LogisticRegression(labelCol="negative", weightCol="weight", maxIter=60, regParam=1.0 / (inverse_regularisation * n), standardization=False)
    return Pipeline(stages=[lr]).fit(rows)


def classification_report(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    cells = predicted.groupBy(F.col(label).cast("int").alias("t"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(
        F.inline(F.array(
            F.struct(F.col("t").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("named"),
                     F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("named"), F.lit(0).cast("bigint").alias("hit")),
        ))
    )
    per = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("support", "named", "hit")])
    precision = F.coalesce(ratio(F.col("hit"), F.col("named")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hit"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * F.col("hit"), F.col("named") + F.col("support")), F.lit(0.0))
    classes = per.select(F.col("c").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hit")
    every = classes.agg(
        F.sum("support").alias("n"), F.sum("hit").alias("hits"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    accuracy = ratio(F.col("hits"), F.col("n"))
    totals = every.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), F.col("n").alias("support")),
        *[F.struct(F.lit(name).alias("class"), *[F.col(f"{k}_{c}").alias(c) for c in ("precision", "recall", "f1")], F.col("n").alias("support"))
          for name, k in (("macro avg", "m"), ("weighted avg", "w"))],
    )))
    return classes.drop("hit").unionByName(totals)


def first_errors(predicted: DataFrame, label: str, prediction: str, key: str, k: int = 5) -> DataFrame:
    return predicted.where(F.col(label) != F.col(prediction)).orderBy(key).limit(k)


# ---------------------------------------------------------------- remaining useful life
RUL_CAP = 125
WINDOW = 30
MIN_STD = 1e-4


def informative_sensors(readings: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """(sensor, std, keep) from one aggregate over all sensors."""
    one = readings.agg(*[F.stddev_samp(s).alias(s) for s in sensors])
    return one.unpivot([], list(sensors), "sensor", "std").withColumn("keep", F.col("std") > MIN_STD)


def window_features(readings: DataFrame, sensors: Sequence[str], window: int = WINDOW, block: int = 4096) -> DataFrame:
    """Per cycle: value, mean of the last ``window`` values and mean of the last ``window`` first differences.

    Units are cut into blocks that overlap by the look-back, so that many tasks share a long unit.
    """
    rows = halo_blocks(positions(readings, ["unit"], "cycle"), "pos", window, block)
    by = Window.partitionBy("unit", "_block").orderBy("pos")
    last = by.rowsBetween(-(window - 1), 0)
    steps = {f"_d_{s}": F.col(s) - F.lag(s).over(by) for s in sensors}
    rows = rows.withColumns(steps)
    made = {}
    for s in sensors:
        made[f"{s}_mean"] = F.avg(s).over(last)
        made[f"{s}_slope"] = F.when(F.count(f"_d_{s}").over(last) >= 2, F.avg(f"_d_{s}").over(last))
    rows = rows.withColumns(made).where(~F.col("_halo"))
    cols = [c for s in sensors for c in (s, f"{s}_mean", f"{s}_slope")]
    return rows.select("unit", "cycle", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def rul_target(readings: DataFrame, cap: int = RUL_CAP, of: DataFrame | None = None) -> DataFrame:
    """Cycles left until the unit's last one, at most ``cap``. ``of`` has the same cycles where ``readings`` are costly to make."""
    last = (readings if of is None else of).groupBy("unit").agg(F.max("cycle").alias("_last"))
    return readings.join(last, "unit").withColumn("rul", F.least(F.col("_last") - F.col("cycle"), F.lit(cap))).drop("_last")


def last_cycle(rows: DataFrame) -> DataFrame:
    """The newest row of every unit, found with a map-side combine."""
    rest = [c for c in rows.columns if c not in ("unit", "cycle")]
    best = rows.groupBy("unit").agg(F.max_by(F.struct("cycle", *rest), "cycle").alias("r"))
    return best.select("unit", "r.*")


def rul_models(train: DataFrame, test: DataFrame, features: Sequence[str], trees: int = 400) -> DataFrame:
    """(model, unit, prediction) of the mean, ridge and boosted models, clipped to [0, cap]."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    fit, apply = assembler.transform(train).select("features", "rul"), assembler.transform(test).select("unit", "features")
    mean = fit.agg(F.avg("rul").alias("m")).select("m").scalar()
    parts = [apply.select(F.lit("mean_baseline").alias("model"), "unit", mean.alias("prediction"))]
    n = fit.count()
    models = {"ridge": LinearRegression(labelCol="rul", regParam=1.0 / n, standardization=False).fit(fit),
              "gradient_boosting": boost(fit, "rul", [1.0], False, trees, step=0.05, bins=32)}
    for name, model in models.items():
        parts.append(model.transform(apply).select(F.lit(name).alias("model"), "unit", F.col("prediction")))
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("prediction", F.greatest(F.lit(0.0), F.least(F.lit(float(RUL_CAP)), F.col("prediction"))))


def rul_scores(rows: DataFrame, by: Sequence[str], true: str, predicted: str) -> DataFrame:
    """RMSE and the asymmetric score that punishes late predictions harder."""
    d = F.col(predicted) - F.col(true)
    penalty = F.when(d < 0, F.exp(-d / 13) - 1).otherwise(F.exp(d / 10) - 1)
    return rows.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.sum(penalty).alias("nasa_score"))


# ---------------------------------------------------------------- experiment log
LOG_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("experiment", T.StringType()), ("run", T.StringType()), ("kind", T.StringType()), ("key", T.StringType()),
    ("value", T.StringType()), ("logged_at", T.TimestampType()))])


def log_run(spark, folder: str, experiment: str, run: str, params: dict, metrics: dict) -> None:
    """Append parameters and metrics of one run as rows."""
    rows = [(experiment, run, kind, k, str(v)) for kind, d in (("param", params), ("metric", metrics)) for k, v in d.items()]
    frame = spark.createDataFrame(rows, "experiment string, run string, kind string, key string, value string")
    frame.withColumn("logged_at", F.current_timestamp()).write.mode("append").partitionBy("experiment").parquet(folder)


def read_log(spark, folder: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(folder)
