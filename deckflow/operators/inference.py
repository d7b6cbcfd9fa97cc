"""Batch inference: request table -> response table, each request sent once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.operators.requests import CONFIRM_FORM
from deckflow.session import materialize, materialize_measured

RESPONSES_SCHEMA = (
    "request_hash string, stage string, raw string, prompt_tokens bigint,"
    " completion_tokens bigint, total_tokens bigint, error string"
)

COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens")

# Requests that one job sends and stores.
SLICE_REQUESTS = 20_000
# Pairs of all blocks, pairs of one and bytes of its texts that are asked about in row order.
IN_ORDER_PAIRS, BLOCK_PAIRS, BLOCK_BYTES = 1_000_000, 250_000, 64_000_000
# Blocks that share a job, and at most so many jobs.
JOB_BLOCKS, IN_ORDER_JOBS = 100, 20

# Answers one prompt: {"raw": str, "prompt_tokens": int, "completion_tokens": int,
# "total_tokens": int}; the token counts may be missing. It may raise.
Infer = Callable[[str, str], dict]


def _told(infer: Infer, stage: str, prompt: str) -> tuple:
    """``(raw, prompt_tokens, completion_tokens, total_tokens, error)`` of one request."""
    answer, error = {}, None
    try:
        answer = infer(stage, prompt) or {}
    except Exception as e:  # one bad item must not fail the others
        error = f"{type(e).__name__}: {e}"
    return answer.get("raw"), *[int(answer.get(c) or 0) for c in COUNTS], error


def infer_requests(requests: DataFrame, infer: Infer, parallelism: int | None = None) -> DataFrame:
    """Send every distinct request; a failing one becomes a row with its error.

    ``infer(stage, prompt)`` runs in the tasks; ``parallelism`` limits how many run
    at a time. Missing token counts are 0.
    """
    distinct = requests.groupBy("request_hash").agg(
        F.first("stage").alias("stage"), F.first("prompt").alias("prompt")
    )
    if parallelism:
        distinct = distinct.repartition(parallelism)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[["request_hash", "stage", "prompt"]].itertuples(index=False)
            rows = [(h, stage, *_told(infer, stage, prompt)) for h, stage, prompt in asked]
            yield pd.DataFrame(
                rows, columns=["request_hash", "stage", "raw", *COUNTS, "error"]
            )

    return distinct.mapInPandas(send, RESPONSES_SCHEMA)


def read_responses(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    """Stored answers, of one stage if given; a store that does not exist yet is empty."""
    from deckflow.sources.tables import read_or_empty

    stored = read_or_empty(spark, path, RESPONSES_SCHEMA)
    return stored if stage is None else stored.where(F.col("stage") == stage)


def cached_inference(
    requests: DataFrame,
    path: str,
    infer: Infer,
    parallelism: int | None = None,
    stage: str | None = None,
    slice_requests: int = SLICE_REQUESTS,
    all_missing: bool = False,
    n_missing: int | None = None,
) -> DataFrame:
    """Answers to ``requests``, sending only what the store at ``path`` lacks.

    The store is partitioned by stage; naming the ``stage`` of the requests reads that part
    alone. Requests are sent in slices of about ``slice_requests`` by their hash, and each
    slice is stored by a job of its own before anything uses it: a run that is killed sends
    the slice again that it was at, and none before it. Failures are stored too, for the
    report, but are sent again next time. ``sent`` tells the answers of this call from
    those that were stored before. A caller that knows that none of its requests, a stored
    table, were answered says so with ``all_missing``, and with ``n_missing`` how many they are.
    """
    spark = requests.sparkSession
    if all_missing:
        missing, n = requests, requests.count() if n_missing is None else n_missing
    else:
        answered = read_responses(spark, path, stage).where("error IS NULL").select("request_hash")
        missing, seen = materialize_measured(
            requests.join(answered, "request_hash", "left_anti"), "missing", n=F.count("*")
        )
        n = seen["n"]
    slices = -(-n // slice_requests)
    place = F.conv(F.substr("request_hash", F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    for k in range(slices):
        some = missing.where(place % slices == k) if slices > 1 else missing
        infer_requests(some, infer, parallelism).write.mode("append").partitionBy("stage").parquet(path)
    stored = read_responses(spark, path, stage)
    asked = requests.select("request_hash").distinct()
    now = missing.select("request_hash").distinct().withColumn("sent", F.lit(True))
    return (
        latest_answer(stored.join(asked, "request_hash", "left_semi"))
        .join(now, "request_hash", "left")
        .withColumn("sent", F.coalesce("sent", F.lit(False)))
    )


def latest_answer(stored: DataFrame) -> DataFrame:
    """One row per request: an answer if there is one, else an error."""
    rest = [c for c in stored.columns if c != "request_hash"]
    best = F.min_by(F.struct(*rest), F.col("error").isNotNull().cast("int")).alias("r")
    return stored.groupBy("request_hash").agg(best).select("request_hash", "r.*")


def quarantine(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Split into usable rows and rows with an ``error``."""
    marked = rows.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def confirm_pairs(
    cards: DataFrame, path: str, infer: Infer, parallelism: int | None = None
) -> Callable[[DataFrame], DataFrame]:
    """A confirmation of near-duplicate pairs by a model.

    ``cards`` has ``id, question, answer``. The result takes ``(block, i, j,
    similarity)``, asks about each of these pairs, and returns those whose answer is an
    explicit yes; a failed or unreadable answer keeps both cards. No two calls may ask
    about one pair.
    """
    from deckflow.functions.answers import parse_answer, redundant_of
    from deckflow.operators.requests import as_requests, confirm_requests

    nothing_stored: list[bool] = []

    def stored_before(spark: SparkSession) -> bool:
        if not nothing_stored:
            nothing_stored.append(read_responses(spark, path, "confirm").isEmpty())
        return not nothing_stored[0]

    def confirm_by(cards: DataFrame) -> Callable[[DataFrame], DataFrame]:
        def confirm(pairs: DataFrame) -> DataFrame:
            for side in ("i", "j"):
                names = {"id": side, "question": f"question_{side}", "answer": f"answer_{side}"}
                pairs = pairs.join(cards.select("id", "question", "answer").withColumnsRenamed(names), side)
            asked = as_requests(confirm_requests(pairs), "confirm")
            asked = asked.select("block", "i", "j", "similarity", "request_hash", "stage", "prompt")
            asked, seen = materialize_measured(asked, "confirm", n=F.count(F.lit(1)))
            if not seen["n"]:
                return asked.select("block", "i", "j", "similarity")
            told = cached_inference(
                asked.select("request_hash", "stage", "prompt"), path, infer, parallelism, "confirm",
                all_missing=not stored_before(asked.sparkSession), n_missing=seen["n"],
            )
            yes = told.where(redundant_of(parse_answer(F.col("raw"))["json"])).select("request_hash")
            return asked.join(yes, "request_hash", "left_semi").select("block", "i", "j", "similarity")

        return confirm

    def in_order(cards: DataFrame) -> Callable[[DataFrame, int], tuple[DataFrame, DataFrame] | None]:
        def ask(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame] | None:
            """``(block, i, j, similarity)`` of the pairs asked about, and of those with a yes.

            A block is one task's, which asks the pairs that a scan in row order asks. Jobs are
            slices of blocks, send about ``SLICE_REQUESTS`` requests at most, and are stored one
            before the next. What is beyond that, or rests on an answer that only Spark can read,
            is left for the next call. None if the ``n`` pairs, the blocks, or the pairs or texts
            of a block are too many.
            """
            if n > IN_ORDER_PAIRS:
                return None
            spark, block = edges.sparkSession, F.col("block")
            ids = edges.select("block", F.explode(F.array("i", "j")).alias("id")).distinct()
            sizes = edges.groupBy("block").agg(F.count("*").alias("n")).join(
                ids.join(cards.select("id", "bytes"), "id").groupBy("block").agg(F.sum("bytes").alias("bytes")), "block"
            )
            blocks, pairs, size = sizes.agg(F.count("*"), F.max("n"), F.max("bytes")).first()
            slices = -(-blocks // JOB_BLOCKS)
            if not 0 < slices <= IN_ORDER_JOBS or pairs > BLOCK_PAIRS or size > BLOCK_BYTES:
                return None
            most = SLICE_REQUESTS // min(blocks, JOB_BLOCKS)
            texts = ids.join(cards.select("id", "question", "answer"), "id").select("block", "id", "question", "answer")
            if stored_before(spark):
                kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema if f.name in ("block", "i", "j"))
                named = materialize(_by_block(edges, texts).applyInArrow(_named_pairs, f"{kind}, request_hash string"), "named")
                answered = read_responses(spark, path, "confirm").where("error IS NULL")
                answers = latest_answer(answered.join(named, "request_hash", "left_semi")).select("request_hash", "raw")
                known = F.map_from_entries(F.collect_set(F.struct("request_hash", "raw"))).alias("known")
                known = named.join(answers, "request_hash").groupBy("block", "i", "j").agg(known)
                edges = edges.join(known, ["block", "i", "j"], "left")
            else:
                edges = edges.withColumn("known", F.lit(None).cast("map<string,string>"))
            edges = edges.select("block", "i", "j", "similarity", "known")

            def scan(pairs: pa.Table, texts: pa.Table) -> pa.Table:
                return _scan(pairs, texts, infer, most)

            kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema if f.name != "known")
            told, unread = None, 0
            for k in range(slices):
                mine = F.pmod(F.xxhash64(block), F.lit(slices)) == k
                asked = _by_block(edges.where(mine), texts.where(mine)).applyInArrow(scan, f"{kind}, yes boolean, sent boolean, {RESPONSES_SCHEMA}")
                if parallelism:
                    asked = asked.coalesce(parallelism)
                asked, seen = materialize_measured(asked, "in_order", sent=F.count_if(F.col("sent")), unread=F.count_if(F.col("yes").isNull()))
                unread += seen["unread"]
                if seen["sent"]:
                    answers = asked.where("sent").select("request_hash", "stage", "raw", *COUNTS, "error")
                    answers.write.mode("append").partitionBy("stage").parquet(path)
                told = asked if told is None else told.unionByName(asked)
            yes = told.where("yes")
            if unread:
                yes = yes.unionByName(told.where("yes IS NULL").where(redundant_of(parse_answer(F.col("raw"))["json"])))
            return tuple(x.select("block", "i", "j", "similarity") for x in (told, yes))

        return ask

    def about(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """The same for pairs of ``edges`` alone: their cards are stored once, not looked up anew in every round.

        Its ``in_order`` asks what is left in row order, where that is little.
        """
        ids = edges.select(F.explode(F.array("i", "j")).alias("id")).distinct()
        size = F.octet_length(F.concat_ws("", "question", "answer")).alias("bytes")
        held = materialize(cards.select("id", "question", "answer", size).join(ids, "id", "left_semi"), "asked_cards")
        confirm = confirm_by(held)
        confirm.in_order = in_order(held)
        return confirm

    confirm = confirm_by(cards)
    confirm.about = about
    return confirm


# --- pairs in row order -----------------------------------------------------------


def _by_block(edges: DataFrame, texts: DataFrame):
    return edges.groupBy("block").cogroup(texts.withColumnRenamed("block", "text_block").groupBy("text_block"))


def _prompts(pairs: pa.Table, texts: pa.Table) -> Callable[[int], list[str]]:
    """The requests of a pair by its place, as ``requests.confirm_requests`` words them.

    One, or as many as cards of the two ids are unlike; none where an id has no card.
    """
    cards: dict = {}
    for k, id in enumerate(texts.column("id").to_pylist()):
        cards.setdefault(id, []).append(k)
    i, j = (pairs.column(side).to_pylist() for side in ("i", "j"))
    columns = [texts.column(c) for c in ("question", "answer")]

    def prompts(k: int) -> list[str]:
        both = product(cards.get(i[k], []), cards.get(j[k], []))
        return list(dict.fromkeys(CONFIRM_FORM.format(*[c[x].as_py() or "" for x in pair for c in columns]) for pair in both))

    return prompts


def _request_hash(prompt: str) -> str:
    """Equals ``requests.request_hash``."""
    return hashlib.sha256(f"confirm\x1f{prompt}".encode()).hexdigest()


def _named_pairs(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    prompts = _prompts(pairs, texts)
    named = [(k, _request_hash(p)) for k in range(pairs.num_rows) for p in prompts(k)]
    at, hashes = zip(*named) if named else ((), ())
    return pairs.select(["block", "i", "j"]).take(pa.array(at, pa.int64())).append_column("request_hash", pa.array(hashes, pa.string()))


def _plain_answer(raw: str | None) -> bool | None:
    """Whether a plain answer says yes; None if it is not plain, and Spark is to read it.

    Plain is a JSON object of texts, yes, no and null, without escapes, fences or a key that comes twice.
    """
    if raw is None:
        return False
    if "\\" in raw or "`" in raw:
        return None

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key comes twice")
        return dict(pairs)

    try:
        read = json.loads(raw, object_pairs_hook=once)
    except (ValueError, RecursionError):
        return None
    if not isinstance(read, dict) or not all(x is None or isinstance(x, bool | str) for x in read.values()):
        return None
    said = read.get("redundant")
    return None if isinstance(said, str) else bool(said)


def _scan(pairs: pa.Table, texts: pa.Table, infer: Infer, most: int) -> pa.Table:
    """The pairs of a block that a scan in row order asks about, with their answers.

    A row asks about one kept row before it at a time, until one drops it. A row whose answer
    is not plain is undecided, and so is one that comes to an undecided row. After ``most``
    requests the scan ends.
    """
    pairs = pairs.sort_by([("j", "ascending"), ("i", "ascending")])
    prompts, rows = _prompts(pairs, texts), []
    i, j, known = (pairs.column(c).to_pylist() for c in ("i", "j", "known"))
    dropped, undecided, last, sent = set(), set(), None, 0
    for k, pair in enumerate(zip(i, j)):
        if sent >= most:
            break
        if j[k] in dropped or j[k] in undecided or i[k] in dropped or pair == last:
            continue
        if i[k] in undecided:
            undecided.add(j[k])
            continue
        last, said, stored = pair, [], dict(known[k] or ())
        for prompt in prompts(k):
            named = _request_hash(prompt)
            told = (stored[named], 0, 0, 0, None) if named in stored else _told(infer, "confirm", prompt)
            sent += named not in stored
            said.append(_plain_answer(told[0]))
            rows.append((k, said[-1], named not in stored, named, "confirm", *told))
        if not said:  # a card is missing: nothing to ask about
            rows.append((k, False, False, None, "confirm", None, 0, 0, 0, None))
        if True in said:
            dropped.add(j[k])
        elif None in said:
            undecided.add(j[k])
    at, *columns = zip(*rows) if rows else [()] * 10
    kinds = {"yes": pa.bool_(), "sent": pa.bool_(), "request_hash": pa.string(), "stage": pa.string(), "raw": pa.string()}
    kinds |= dict.fromkeys(COUNTS, pa.int64()) | {"error": pa.string()}
    asked = pairs.select(["block", "i", "j", "similarity"]).take(pa.array(at, pa.int64()))
    for (name, kind), values in zip(kinds.items(), columns):
        asked = asked.append_column(name, pa.array(values, kind))
    return asked
