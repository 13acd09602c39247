"""Reading and writing of line-oriented records, manifests, runs and indexes."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone import schemas


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _path(spark, path)
    return fs.delete(p, True)


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker) of a list file: comments from # on and blanks go, upper case. A missing file is an error."""
    lines = spark.read.text(path).select(F.upper(F.trim(F.element_at(F.split("value", "#"), 1))).alias("ticker"))
    return lines.where("ticker <> ''")


def read_strict(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines of exactly this schema: a broken line fails the read; a missing path is empty if that is allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that are broken or no objects."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_recovered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an interrupted writer: the last line of each file may be incomplete and is left out; a broken line before it is an error.

    Each file is cut in its own partition; only files of this kind, one per writer, are read so.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    complete = F.regexp_replace("value", r"[^\n]*$", "")
    lines = raw.select(F.explode(F.split(complete, "\n")).alias("line")).where("trim(line) <> ''")
    parsed = lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def line_problems(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(line, problem) of a questions file: broken JSON, no object, no key, repeated key. A byte order mark and blank lines are allowed.

    Lines are numbered by file and offset, so large files are read in parallel pieces only after the numbering of one file, which is a benchmark's size.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = raw.select(F.posexplode(F.split("value", "\n")).alias("n", "text")).where("trim(text) <> ''")
    v = F.try_parse_json("text")
    name = F.get_json_object("text", f"$.{key}")
    marked = lines.select((F.col("n") + 1).alias("line"), v.isNull().alias("broken"), F.schema_of_variant(v).startswith("OBJECT").alias("object"), name.alias("k"))
    twice = F.count(F.lit(1)).over(W.partitionBy("k")) > 1
    problem = (
        F.when(F.col("broken"), "no JSON").when(~F.col("object"), "no object").when(F.col("k").isNull(), f"no {key}").when(twice, f"repeated {key}")
    )
    return marked.withColumn("problem", problem).where("problem is not null").select("line", "problem")


def question_problems(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(question_id, problem): unknown type, an unanswerable question with passages or an answerable one without, passages both supporting and negative, and ids of no passage."""
    kinds = ("factual", "comparative", "temporal", "numeric", "unanswerable")
    sup, neg = F.coalesce("supporting_chunk_ids", F.array().cast("array<string>")), F.coalesce("hard_negative_chunk_ids", F.array().cast("array<string>"))
    of = lambda cond, text: F.when(cond, F.lit(text))
    own = questions.select(
        "question_id",
        F.explode(
            F.array_compact(
                F.array(
                    of(F.trim(F.coalesce("question", F.lit(""))) == "", "no question"),
                    of(~F.coalesce(F.col("question_type").isin(*kinds), F.lit(False)), "unknown type"),
                    of((F.col("question_type") == "unanswerable") != (F.size(sup) == 0), "passages and type do not agree"),
                    of(F.arrays_overlap(sup, neg), "a passage is supporting and negative"),
                )
            )
        ).alias("problem"),
    )
    named = questions.select("question_id", F.explode(F.concat(sup, neg)).alias("chunk_id")).distinct()
    lost = named.join(passages.select(F.col("chunk_id").cast("string").alias("chunk_id")), "chunk_id", "left_anti")
    return own.unionByName(lost.select("question_id", F.concat(F.lit("no passage "), F.col("chunk_id")).alias("problem")))


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds rows to a log; each call is one commit, so a stopped run leaves whole batches only."""
    rows.write.mode("append").json(path)


def replace_table(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes beside the old table and, once that is complete, moves the old one aside and the new one into its place.

    Between the two moves there is no table at ``path``: a reader then finds nothing, never a mixture, and after a crash there ``recover`` puts a whole table back. A move that the file system refuses is an error and leaves the old table.
    """
    spark = rows.sparkSession
    recover(spark, path)
    fs, p, jvm = _path(spark, path)
    fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{x}") for x in ("fresh", "old"))
    fs.delete(fresh, True)
    rows.write.format(form).save(str(fresh))
    if fs.exists(p) and not fs.rename(p, old):
        raise OSError(f"{path} cannot be moved aside")
    if not fs.rename(fresh, p):
        if fs.exists(old):
            fs.rename(old, p)
        raise OSError(f"the new table cannot be moved to {path}")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash inside replace_table: puts the new table in place if it was complete, else the old one back."""
    fs, p, jvm = _path(spark, path)
    fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{x}") for x in ("fresh", "old"))
    if not fs.exists(p) and fs.exists(old):
        whole = fs.exists(jvm.org.apache.hadoop.fs.Path(fresh, "_SUCCESS"))
        fs.rename(fresh if whole else old, p)
    if fs.exists(p):
        fs.delete(old, True)


def new_only(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet: the increment of a resumable stage."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def write_comparison(summaries: DataFrame, run_dir: str, columns: list[str]) -> None:
    """CSV with a header, in the order of ``columns`` (absent ones empty, others left out), and the same rows as JSON; a run's summaries are one file each."""
    have = set(summaries.columns)
    table = summaries.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).coalesce(1)
    flat = table.select(*[F.to_json(c).alias(c) if isinstance(table.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in columns])
    flat.write.mode("overwrite").option("header", True).csv(f"{run_dir}/summary")
    summaries.coalesce(1).write.mode("overwrite").json(f"{run_dir}/manifest")


def read_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of all runs below a folder with run and modification time, the newest run first; broken lines are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(root)
    named = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    run = F.regexp_extract("file", r"([^/]+)/[^/]+/?$", 1)
    return named.withColumn("run", run).drop("file").orderBy(F.col("modified").desc(), "run")


def corpus_rows(filings: DataFrame) -> DataFrame:
    """Chunked filings as passages: chunk columns, the filing's identity, its fiscal year and its settings."""
    from quarrystone.functions.text import fiscal_year

    return filings.withColumn("c", F.explode("chunks")).select(
        "c.*", "ticker", "cik", "company", "form", "filing_date", "accession_no", "url", "period_of_report", fiscal_year(F.col("period_of_report")).alias("fiscal_year"), "chunk_budget", "chunk_overlap", "key_items_only"
    )


def save_index(tables: dict[str, DataFrame], manifest: DataFrame, path: str) -> None:
    """Writes the tables of an index; the manifest goes first when an old index is replaced and comes last, so an index without one is unfinished."""
    spark = manifest.sparkSession
    remove(spark, f"{path}/manifest")
    for name, df in tables.items():
        replace_table(df, f"{path}/{name}")
    replace_table(manifest.coalesce(1), f"{path}/manifest", "json")


def load_index(spark: SparkSession, path: str, names: list[str], fingerprint: str) -> dict[str, DataFrame]:
    """Tables of an index, refused without a manifest or with another fingerprint than the corpus has."""
    if not exists(spark, f"{path}/manifest"):
        raise ValueError("the index has no manifest: it was never finished")
    row = spark.read.json(f"{path}/manifest").first()
    if row is None or row["fingerprint"] != fingerprint:
        raise ValueError("the index was built from another corpus")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
