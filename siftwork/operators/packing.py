"""Scorer input text, batch packing, token budgets and batch inference."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.config import Settings
from siftwork.functions import fixed_values as fv
from siftwork.functions.terms import split_terms
from siftwork.functions.text import canonical_url, trim_boilerplate
from siftwork.operators.ranking import global_rank
from siftwork.session import scratch_dir

UNREAD_NOTE = "[DESCRIPTION UNAVAILABLE: judge from company, title and location; keep confidence at 40 or below.]"


def posting_block(p: DataFrame) -> Column:
    """Full scorer input for one posting: metadata lines, then trimmed text."""
    body = trim_boilerplate(p.description_text)
    body = F.when(p.description_text.isNull(), F.lit(UNREAD_NOTE)).when(
        F.length(body) > fv.SCORER_TEXT_CHARS, F.concat(F.substring(body, 1, fv.SCORER_TEXT_CHARS), F.lit("\n[... truncated]"))).otherwise(body)
    place = F.when(F.coalesce(p.location, F.lit("")) == "", F.lit("unspecified")).otherwise(p.location)
    terms = F.array_join(split_terms(p.terms_txt), ", ")
    meta = F.concat_ws(
        "\n", F.concat(F.lit("job_id: "), p.job_id.cast("string")), F.concat(F.lit("company: "), p.company_name),
        F.concat(F.lit("title: "), p.title), F.concat(F.lit("location: "), place),
        F.when(terms != "", F.concat(F.lit("terms: "), terms)),
        F.when(p.sponsorship != "", F.concat(F.lit("sponsorship: "), p.sponsorship)),
        F.concat(F.lit("url: "), canonical_url(p.url)))
    return F.concat(meta, F.lit("\n--- description ---\n"), body)


def triage_block(s: Settings, p: DataFrame) -> Column:
    head = F.replace(F.substring(trim_boilerplate(F.coalesce(p.description_text, F.lit(""))), 1, s.triage_chars), F.lit("\n\n"), F.lit("\n"))
    place = F.when(F.coalesce(p.location, F.lit("")) == "", F.lit("unspecified")).otherwise(p.location)
    return F.concat(F.lit("job_id: "), p.job_id.cast("string"), F.lit(" | "), p.company_name, F.lit(" | "), p.title, F.lit(" | "),
                    place, F.lit("\n"), F.when(head == "", F.lit("[no description available]")).otherwise(head))


QUEUE_ORDER = [("likelihood", "desc"), ("first_seen_at", "desc"), ("eval_seq", "asc")]


def queue_rank(queue: DataFrame, name: str = "n") -> DataFrame:
    """Position in the ambiguous queue: best local score, then newest, then oldest evaluation id."""
    return global_rank(queue, QUEUE_ORDER, name=name)


def batch_prompts(queue: DataFrame, block: Column, size: int) -> DataFrame:
    """(batch, jobs, job_ids, prompt): one prompt per batch of ``size`` queued postings; a group is at most ``size`` rows."""
    rows = queue_rank(queue.withColumn("block", block).select("job_id", "likelihood", "first_seen_at", "eval_seq", "block"))
    rows = rows.withColumn("batch", F.floor((F.col("n") - 1) / size))
    packed = rows.groupBy("batch").agg(F.count("*").alias("jobs"), F.array_sort(F.collect_list(F.struct("n", "job_id", "block"))).alias("r"))
    ids = F.array_join(F.transform("r", lambda x: x["job_id"].cast("string")), ", ")
    text = F.array_join(F.transform("r", lambda x: x["block"]), "\n\n---\n\n")
    return packed.select("batch", "jobs", F.transform("r", lambda x: x["job_id"]).alias("job_ids"), F.concat(
        F.lit("Triage these "), F.col("jobs").cast("string"), F.lit(" postings. Return one entry per job_id: "), ids, F.lit(".\n\n"), text).alias("prompt"))


def pack_batches(s: Settings, postings: DataFrame) -> DataFrame:
    """(job_id, class, batch): readable rows in batches of ``batch_size``, unread ones denser but capped."""
    unread = F.col("description_text").isNull()
    rows = postings.select("job_id", F.when(unread, F.lit("unread")).otherwise(F.lit("read")).alias("class"))
    ranked = global_rank(rows, [("job_id", "asc")], keys=["class"], name="n")
    size = F.when(F.col("class") == "unread", F.lit(min(3 * s.batch_size, fv.UNREAD_BATCH_MAX))).otherwise(F.lit(s.batch_size))
    return ranked.select("job_id", "class", F.floor((F.col("n") - 1) / size).alias("batch"))


CHUNK_WAVES = 512


def budget_waves(s: Settings, batches: DataFrame, budget: int | None, chunk: int = CHUNK_WAVES) -> DataFrame:
    """Which batches start under a token budget. ``batches`` has (batch, tokens), tokens = what the call will cost.

    Batches go in waves of ``concurrency``. Before a wave the cost of a batch is estimated as the largest measured so
    far (a first guess before any); the wave shrinks to what fits and the run stops when nothing does. Without a budget
    all batches are one wave. Returns (batch, wave, runs).

    A wave depends on all before it, so waves are scanned in chunks of ``chunk``: one grouped aggregation folds a chunk from
    the state (spent, most, stopped) that the chunk before left, stores a row per wave, and hands on the last one. No row
    holds more than one chunk, whatever a batch costs, and the scan ends once stopped.
    """
    if budget is None:
        return batches.select("batch", F.lit(0).cast("bigint").alias("wave"), F.lit(True).alias("runs"))
    k = s.concurrency
    root = scratch_dir(batches.sparkSession, "waves")
    rows = batches.select("batch", "tokens", F.floor(F.col("batch") / k).alias("wave"), (F.col("batch") % k).alias("pos")).withColumn("chunk", F.floor(F.col("wave") / chunk))
    rows.repartitionByRange("wave").sortWithinPartitions("wave").write.parquet(f"{root}/batches")   # a chunk is a few row groups
    rows = batches.sparkSession.read.schema(rows.schema).parquet(f"{root}/batches")
    last = rows.agg(F.max("chunk")).first()[0]
    spent, most, stopped = 0, 0, False
    for number in range(0 if last is None else last + 1):
        if stopped:
            break
        part = _fold_chunk(rows.where(F.col("chunk") == number), k, budget, spent, most)
        part.write.parquet(f"{root}/fits/chunk={number}")
        state = batches.sparkSession.read.parquet(f"{root}/fits/chunk={number}").orderBy(F.desc("wave")).first()
        if state is not None:
            spent, most, stopped = state.spent, state.most, state.stopped
    if last is None:
        return rows.select("batch", "wave", F.lit(False).alias("runs"))
    fits = batches.sparkSession.read.parquet(f"{root}/fits").select("wave", "fit")
    return rows.join(fits, "wave", "left").select("batch", "wave", (F.col("pos") < F.coalesce("fit", F.lit(0))).alias("runs"))


def _fold_chunk(rows: DataFrame, k: int, budget: int, spent: int, most: int) -> DataFrame:
    """(wave, fit, spent, most, stopped) of the waves of one chunk, from the state before it."""
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<struct<wave:bigint,fit:bigint,spent:bigint,most:bigint,stopped:boolean>>")
    waves = rows.groupBy("wave").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tokens"))), lambda x: x["tokens"].cast("bigint")).alias("costs"))   # at most k
    plan = waves.agg(F.array_sort(F.collect_list(F.struct(F.col("wave").cast("bigint").alias("wave"), "costs"))).alias("waves"))                           # at most a chunk

    def step(st, w):
        est = F.when(st["most"] > 0, st["most"]).otherwise(F.lit(fv.FIRST_BATCH_TOKENS))
        fit = F.when(st["stopped"], zero).otherwise(F.greatest(zero, F.floor((F.lit(budget) - st["spent"]) / est)))
        costs = F.slice(w["costs"], F.lit(1), F.least(fit, F.lit(k)).cast("int"))
        after = [(st["spent"] + F.aggregate(costs, zero, lambda a, x: a + x)).alias("spent"), F.greatest(st["most"], F.coalesce(F.array_max(costs), zero)).alias("most"), (st["stopped"] | (fit <= 0)).alias("stopped")]
        return F.struct(*after, F.array_append(st["out"], F.struct(w["wave"].alias("wave"), fit.alias("fit"), *after)).alias("out"))

    start = F.struct(F.lit(spent).cast("bigint").alias("spent"), F.lit(most).cast("bigint").alias("most"), F.lit(False).alias("stopped"), none.alias("out"))
    return plan.select(F.explode(F.aggregate("waves", start, step)["out"]).alias("f")).select("f.*")


SCORER_SCHEMA = "batch bigint, job_id bigint, score int, error string"


def batch_inference(batches: DataFrame, scorer: Callable[[int, str], dict[int, int]], retries: int = 1) -> DataFrame:
    """(batch, job_id, score, error) for every posting of every batch (batch, job_ids, prompt).

    ``scorer`` takes a batch number and its prompt and returns a score from 0 to 100 per job id. An answer that is not of that
    form, or an error, is tried again ``retries`` times; a batch that still fails passes through with NULL scores and the error,
    and a posting that a valid answer omits gets a NULL score and no error.
    """
    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for pdf in frames:
            out = []
            for batch, ids, prompt in zip(pdf["batch"], pdf["job_ids"], pdf["prompt"]):
                scores, error = {}, None
                for _ in range(1 + retries):
                    try:
                        scores, error = _valid_scores(scorer(int(batch), prompt), {int(i) for i in ids}), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a scorer raises concerns its batch only
                        scores, error = {}, str(e)[:300]
                out += [(batch, int(i), scores.get(int(i)), error) for i in ids]
            yield pd.DataFrame(out, columns=["batch", "job_id", "score", "error"]).astype({"score": "Int32"})
    return batches.select("batch", "job_ids", "prompt").mapInPandas(run, SCORER_SCHEMA)


def _valid_scores(answer: object, ids: set[int]) -> dict[int, int]:
    if not isinstance(answer, dict) or not all(isinstance(v, int) and 0 <= v <= 100 and k in ids for k, v in answer.items()):
        raise ValueError("invalid scorer output")
    return answer


def word_count_scorer(batch: int, prompt: str) -> dict[int, int]:
    """Deterministic stand-in for an external scorer: words of each posting block modulo 101; refuses every third batch."""
    if batch % 3 == 1:
        raise RuntimeError("scorer refused the batch")
    blocks = prompt.partition("\n\n")[2].split("\n\n---\n\n")
    return {int(b.split(" ", 2)[1]): len(b.split()) % 101 for b in blocks}
