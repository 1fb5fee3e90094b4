"""Reading of gate jobs and writing of verdicts as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquote import schemas
from lumenquote.functions.text import trim_blank
from lumenquote.operators.gate import gate_jobs
from lumenquote.operators.judge import Judge


def read_jobs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, sources, rejects) of files with one job per line, read with a fixed schema.

    answer_id is a hash of the answer and its sources, so that it does not depend on how the files are split; the same job
    twice is one. Jobs that are no JSON or have a blank answer are rejects. sources that are no array count as none.
    """
    raw = spark.read.text(path).select(F.col("value").alias("job")).filter(trim_blank(F.col("job")) != "")
    raw = raw.withColumn("answer_id", F.xxhash64("job")).dropDuplicates(["answer_id", "job"])
    parsed = raw.withColumn("j", F.from_json("job", schemas.GATE_JOB))
    blank = trim_blank(F.coalesce(F.col("j.answer"), F.lit(""))) == ""
    rejects = parsed.filter(blank).select("answer_id", "job", F.lit("error").alias("verdict"))
    good = parsed.filter(~blank)
    answers = good.select("answer_id", F.col("j.answer").alias("answer"), F.col("j.options.thresholds.minScore").alias("min_score"), F.col("j.options.thresholds.minUncitedChars").alias("min_uncited_chars"), F.col("j.options.judge").alias("judge"))
    rows = good.select("answer_id", F.posexplode("j.sources").alias("_p", "_s"))
    sources = rows.select("answer_id", (F.col("_p") + 1).alias("source_index"), "_s.id", "_s.title", "_s.url", F.coalesce("_s.text", F.lit("")).alias("text"), F.coalesce("_s.extraTexts", F.array().cast("array<string>")).alias("extra_texts"))
    return answers, sources, rejects


def job_verdicts(spark: SparkSession, path: str, judge: Judge | None = None) -> DataFrame:
    """One row per job of the files: verdict, exit_code, summary, problems, uncited, warnings, instructions; rejects are verdict error with all else empty."""
    answers, sources, rejects = read_jobs(spark, path)
    verdicts = gate_jobs(answers, sources, judge)
    lost = rejects.select("answer_id", F.lit(0).alias("n_problems"), F.lit(0).alias("n_uncited"), "verdict", F.lit(1).alias("exit_code"))
    return verdicts.unionByName(lost, allowMissingColumns=True)


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """One JSON object per job, in the names of the gate's contract; null fields are written too."""
    v = {c: F.col(c) for c in verdicts.columns}
    empty = F.array().cast("array<string>")
    out = {"answerId": v["answer_id"], "verdict": v["verdict"], "exitCode": v["exit_code"]}
    if "summary" in v:
        s = v["summary"]
        out["summary"] = F.struct(s["citation_count"].alias("citationCount"), s["verbatim_rate"].alias("verbatimRate"), s["entailed_rate"].alias("entailedRate"), s["mean_score"].alias("meanScore"), s["min_score"].alias("minScore"))

    def problem(x: Column) -> Column:
        judged = F.when(x["class"].isNotNull(), F.struct(x["class"].alias("class"), x["confidence"].alias("confidence"), x["reasons"].alias("reasons")))
        return F.struct(
            x["claim_id"].alias("claimId"), x["source_index"].alias("sourceIndex"), x["claim_text"].alias("claimText"), x["type"].alias("type"),
            F.struct(x["method"].alias("method"), x["text_score"].alias("score")).alias("textMatch"), judged.alias("entailment"), x["score"].alias("score"),
        )

    out["problems"] = F.coalesce(F.transform("problems", problem), F.array())
    out["uncited"] = F.coalesce("uncited", empty)
    if "warnings" in v:
        out["warnings"] = F.coalesce("warnings", empty)
    out["instructionsForModel"] = v["instructions"]
    verdicts.select(*[c.alias(n) for n, c in out.items()]).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
