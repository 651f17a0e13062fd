"""Who speaks how: features, roles, shares, timeline, pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from .chunks import words
from .sweep import with_previous

SLAB_CS = 60_000


def features(rows: DataFrame, teacher: list[str], student: list[str], text: str = "text") -> DataFrame:
    """With n_words, is_question, n_clauses, n_distinct, n_letters, distinct_permille (of the words how many are different), letters_milli (mean letters a word) and marker_score (teacher's markers held less the student's; a marker named twice counts twice). Without words the means are 0."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.filter(F.split(t, r"[ \n\t\r]+"), lambda x: x != "")

    def held(markers: list[str]) -> Column:
        out = F.lit(0)
        for m in markers:
            out = out + F.contains(t, F.lit(m.lower())).cast("int")
        return out

    per_word = lambda c: F.when(F.col("n_words") > 0, F.floor(F.col(c) * 1000 / F.col("n_words"))).otherwise(0).cast("int")
    return (
        rows.withColumn("n_words", F.size(words)).withColumn("is_question", F.contains(t, F.lit("?")))
        .withColumn("n_clauses", F.size(F.split(t, ",")).cast("int")).withColumn("n_distinct", F.size(F.array_distinct(words)))
        .withColumn("n_letters", F.length(F.array_join(words, ""))).withColumn("distinct_permille", per_word("n_distinct")).withColumn("letters_milli", per_word("n_letters"))
        .withColumn("marker_score", held(teacher) - held(student))
    )


def cluster_roles(rows: DataFrame, columns: list[str], length: str = "n_words", k: int = 2, seed: int = 42) -> DataFrame:
    """With cluster and role: standardised k-means, the cluster of greater mean length is the teacher, a tie goes to cluster 1.

    Rows with a null feature are left out; fewer than two distinct rows make
    one cluster, which is the teacher.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(rows)
    if len(data.select("__v").distinct().take(k)) < k:
        return data.drop("__v").withColumn("cluster", F.lit(0)).withColumn("role", F.lit("teacher"))
    scaled = StandardScaler(inputCol="__v", outputCol="__s", withMean=True).fit(data).transform(data)
    found = KMeans(k=k, seed=seed, featuresCol="__s", predictionCol="cluster").fit(scaled).transform(scaled).drop("__v", "__s")
    # Of at most k rows one comes to the driver.
    teacher = found.groupBy("cluster").agg(F.avg(length).alias("m")).orderBy(F.desc("m"), F.desc("cluster")).first()["cluster"]
    return found.withColumn("role", F.when(F.col("cluster") == teacher, "teacher").otherwise("student"))


def refined(rows: DataFrame, video: str = "video_id", order: tuple[str, ...] = ("start_cs", "seg_index"), label: str = "label", text: str = "text") -> DataFrame:
    """Labels after the flow: what follows a question by the other side is an answer. Reads the labels as they came, so one pass suffices.

    A teacher's row that follows a teacher's question, without a question of
    its own and of under ten words, becomes the student's.
    """
    r = with_previous(rows, [video], list(order), [label, text], SLAB_CS, "__prev_")
    before, said, own = F.col(f"__prev_{label}"), F.col(f"__prev_{text}"), F.coalesce(F.col(text), F.lit(""))
    answer = (before == "teacher") & F.contains(said, F.lit("?")) & (F.col(label) == "teacher") & ~F.contains(own, F.lit("?")) & (word_count(own) < 10)
    return r.withColumn("refined", F.when(F.coalesce(answer, F.lit(False)), F.lit("student")).otherwise(F.col(label))).drop(f"__prev_{label}", f"__prev_{text}")


def shares(rows: DataFrame, video: str = "video_id", label: str = "label") -> DataFrame:
    """video, label, n_segments, spoken_cs, time_permille, segment_permille, n_words, words_milli (mean words a segment): the totals come from the labels' few rows."""
    length = F.greatest(F.coalesce(F.col("end_cs") - F.col("start_cs"), F.lit(0)), F.lit(0))
    by = rows.groupBy(video, label).agg(F.count("*").alias("n_segments"), F.sum(length).alias("spoken_cs"), F.sum(words(rows)).alias("n_words"))
    w = Window.partitionBy(video)
    part = lambda c: F.floor(F.col(c) * 1000 / F.greatest(F.sum(c).over(w), F.lit(1)))
    return by.withColumn("time_permille", part("spoken_cs")).withColumn("segment_permille", part("n_segments")).withColumn("words_milli", F.floor(F.col("n_words") * 1000 / F.col("n_segments")))


def labelled(rows: DataFrame, labels: DataFrame, key: list[str], label: str = "label", unknown: str = "unknown") -> DataFrame:
    """Rows with the label that stands at the same place in ``labels`` (key, label; a place has one), ``unknown`` where none does. Labels without a row are dropped, as by a zip of two lists."""
    at = labels.where(F.col(label).isNotNull()).groupBy(*key).agg(F.min(label).alias("__label"))
    return rows.join(at, key, "left").select(*[c for c in rows.columns if c != label], F.coalesce("__label", F.lit(unknown)).alias(label))


def speakers_counted(rows: DataFrame, video: str = "video_id", label: str = "label") -> DataFrame:
    return rows.groupBy(video).agg(F.count_distinct(label).alias("n_speakers"))


def timeline(rows: DataFrame, video: str = "video_id", label: str = "label", slab_cs: int = SLAB_CS) -> DataFrame:
    """video, label, from_cs, to_cs, n_segments: runs of neighbouring rows of one label.

    Runs are found within slabs of media time and put together over one or two
    rows a slab, so a long video isn't one task.
    """
    key = F.floor(F.col("start_cs") / slab_cs)
    w = Window.partitionBy(video, "slab").orderBy("start_cs", "seg_index")
    r = rows.withColumn("slab", key).withColumn("__new", ((F.row_number().over(w) == 1) | ~F.lag(label).over(w).eqNullSafe(F.col(label))).cast("int"))
    runs = (
        r.withColumn("run", F.sum("__new").over(w)).groupBy(video, "slab", "run")
        .agg(F.first(label).alias(label), F.min("start_cs").alias("from_cs"), F.max("end_cs").alias("to_cs"), F.count("*").alias("n_segments"))
    )
    edge = runs.withColumn("last", F.max("run").over(Window.partitionBy(video, "slab"))).withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.col("last")))
    o = Window.partitionBy(video).orderBy("slab", "run")
    same = (F.lag(label).over(o).eqNullSafe(F.col(label))) & (F.lag("slab").over(o) < F.col("slab")) & (F.lag("last").over(o) == F.lag("run").over(o)) & (F.col("run") == 1)
    ends = edge.where("edge").withColumn("g", F.sum(F.coalesce((~same).cast("int"), F.lit(1))).over(o))
    joined = ends.groupBy(video, "g").agg(F.first(label).alias(label), F.min("from_cs").alias("from_cs"), F.max("to_cs").alias("to_cs"), F.sum("n_segments").alias("n_segments")).drop("g")
    return edge.where("not edge").select(video, label, "from_cs", "to_cs", "n_segments").unionByName(joined.select(video, label, "from_cs", "to_cs", "n_segments"))


def pacing(rows: DataFrame, video: str = "video_id") -> DataFrame:
    """video, n_words, spoken_cs, milli_wpm: thousandths of words a minute, null where nothing was spoken."""
    by = rows.groupBy(video).agg(F.sum(words(rows)).alias("n_words"), F.sum(F.greatest(F.coalesce(F.col("end_cs") - F.col("start_cs"), F.lit(0)), F.lit(0))).alias("spoken_cs"))
    return by.withColumn("milli_wpm", F.when(F.col("spoken_cs") > 0, F.floor(F.col("n_words") * 6_000_000 / F.col("spoken_cs"))))


def pauses(rows: DataFrame, video: str = "video_id", at_least_cs: int = 1) -> DataFrame:
    """video, seg_index, pause_cs: silence since the end of the row before, of at least ``at_least_cs``."""
    r = with_previous(rows, [video], ["start_cs", "seg_index"], ["end_cs"], SLAB_CS)
    return r.withColumn("pause_cs", F.col("start_cs") - F.col("prev_end_cs")).where(F.col("pause_cs") >= at_least_cs).select(video, "seg_index", "pause_cs")
