"""Pipeline inputs derived from the given tables.

The tables hold no course files, so file names, themes, cards and so on are
expressions over their keys. Each expression is written once, in the SQL that Spark
and the checking engine share, and covers whole tables. One subject always holds a
third of its rows, as real subjects may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.functions import text
from deckflow.functions.ids import BASE62_DIGITS
from deckflow.functions.text import deck_name
from deckflow.operators import store
from deckflow.sources.files import with_path_parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- files, from page addresses ---------------------------------------------

PAGE_FOLDER = (
    "regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/$', '')"
)
PAGE_FILE = """CASE page_id % 11
    WHEN 0 THEN 'Unit ' || page_id || '.pdf'
    WHEN 1 THEN 'Unit ' || page_id || '.pptx'
    WHEN 2 THEN 'Unit ' || page_id || '.ppt'
    WHEN 3 THEN 'Unit ' || page_id || '.md'
    WHEN 4 THEN 'Unit ' || page_id || '.txt'
    WHEN 5 THEN 'Unit ' || page_id || '.PDF'
    WHEN 6 THEN 'Unit ' || page_id || '.html'
    WHEN 7 THEN 'Unit ' || page_id || '.ocr.md'
    WHEN 8 THEN '.syncthing.' || page_id || '.md'
    WHEN 9 THEN 'syncthing-' || page_id || '.txt'
    ELSE 'Unit ' || page_id || '.TXT' END"""
PAGE_PATH = f"'/in/' || {PAGE_FOLDER} || '/' || {PAGE_FILE}"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(PAGE_PATH).alias("path"))
    return with_path_parts(pages)


FILES_SQL = f"""
files AS (
  SELECT page_id, path, name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder,
         regexp_extract(name, '[^.]([.][^.]*)$', 1) AS ext
  FROM (SELECT page_id, {PAGE_PATH} AS path, {PAGE_FILE} AS name FROM pages))"""

# --- documents with names ----------------------------------------------------

DOC_FOLDER = "'/in/src' || (doc_id {div} 40)"
DOC_STEM = """'Doc ' || (doc_id {div} 6) || CASE doc_id % 6
    WHEN 0 THEN '' WHEN 1 THEN ' Annotated' WHEN 2 THEN ' TD' WHEN 3 THEN ' TD Corrected'
    WHEN 4 THEN ' Slides' ELSE ' Notes' END"""
DOC_EXT_RANK = "CAST((doc_id {div} 3) % 5 AS INT)"
DOC_EXT = f"""CASE {DOC_EXT_RANK} WHEN 0 THEN '.pdf' WHEN 1 THEN '.pptx' WHEN 2 THEN '.ppt'
    WHEN 3 THEN '.md' ELSE '.txt' END"""
DOC_BLANK = "(doc_id % 10 = 0 OR (doc_id {div} 12) % 5 = 0)"


def spark_sql(expression: str) -> str:
    return expression.replace("{div}", "div")


def other_sql(expression: str) -> str:
    return expression.replace("{div}", "//")


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .select(
            "doc_id",
            "text",
            F.expr(spark_sql(DOC_FOLDER)).alias("folder"),
            F.expr(spark_sql(DOC_STEM)).alias("stem"),
            F.expr(spark_sql(DOC_EXT)).alias("ext"),
            F.expr(spark_sql(DOC_EXT_RANK)).alias("ext_rank"),
        )
        .withColumn("name", F.concat("stem", "ext"))
        .withColumn("path", F.concat_ws("/", "folder", "name"))
    )


DOCS_SQL = other_sql(f"""
docs AS (
  SELECT *, lower(trim(regexp_replace(stem,
      '(?i)\\s*({text.VARIANT_WORDS})\\s*$', ''))) AS base_name,
    CASE WHEN regexp_matches(stem, '(?i)\\b({text.CORRECTED_WORDS})\\b') THEN 'td_corrected'
         WHEN regexp_matches(stem, '(?i)\\b({text.EXERCISE_WORDS})\\b') THEN 'td'
         WHEN regexp_matches(stem, '(?i)\\b({text.ANNOTATED_WORDS})\\b') THEN 'lecture_annotated'
         ELSE 'lecture' END AS doc_type
  FROM (SELECT *, stem || ext AS name, folder || '/' || stem || ext AS path
        FROM (SELECT doc_id, text, {DOC_FOLDER} AS folder, {DOC_STEM} AS stem, {DOC_EXT} AS ext,
                     {DOC_EXT_RANK} AS ext_rank FROM documents)))""")

# Of several files of one type in a group the last one counts.
MEMBERS_SQL = (
    DOCS_SQL
    + """,
members AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folder, base_name, doc_type
                 ORDER BY ext_rank DESC, path DESC) AS r FROM docs) WHERE r = 1)"""
)

# --- analyses, from parts ------------------------------------------------------

THEME_SUBJECT = """CASE WHEN (p_partkey {div} 4) % 3 = 0 THEN 'Subject 0'
    ELSE 'Subject ' || ((p_partkey {div} 4) % 50) END"""
THEME_GROUP = "'doc ' || (p_partkey {div} 4)"
THEME_NAME = "p_name || ' ' || (p_size % 3)"
FIRST_WORD = "regexp_extract(name, '^([a-z]+) ', 1)"
CANONICAL = "regexp_extract(name, '^[a-z]+ ([a-z]+) ', 1)"
# Names with these first words are left out of every answer, or called new by it.
FORGOTTEN, NEW = "hot", "blue"


def theme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    recall = F.when(F.expr("p_size % 4 <> 0"), F.array("p_brand", F.expr("'size ' || p_size")))
    problem = F.when(F.expr("p_size % 5 < 2"), F.array(F.expr("p_type || ' problem'")))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr(spark_sql(THEME_SUBJECT)).alias("subject"),
        F.expr(spark_sql(THEME_GROUP)).alias("base_name"),
        F.expr(THEME_NAME).alias("name"),
        F.coalesce(recall, none).alias("recall_concepts"),
        F.coalesce(problem, none).alias("problem_types"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document group with its (four) proposed themes."""
    theme = F.struct("name", "recall_concepts", "problem_types")
    return (
        theme_rows(spark, sf_dir)
        .groupBy("subject", "base_name")
        .agg(F.array_sort(F.collect_list(F.struct("p_partkey", theme.alias("t")))).alias("themes"))
        .select(
            "subject",
            F.concat(F.lit("/in/"), "subject").alias("folder"),
            "base_name",
            F.col("themes.t").alias("themes"),
        )
    )


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer per subject: aliases under canonicals, new themes, and some left out.

    Every canonical also lists 'shared' and the subject's first canonical, so that
    later entries must win.
    """
    names = (
        theme_rows(spark, sf_dir)
        .select("subject", "name")
        .distinct()
        .withColumn("w", F.expr(FIRST_WORD))
        .withColumn("canonical", F.expr(CANONICAL))
    )
    listed = F.when(~F.col("w").isin(FORGOTTEN, NEW), F.col("name"))
    per_canonical = names.groupBy("subject", "canonical").agg(
        F.array_sort(F.collect_list(listed)).alias("names")
    )
    new = F.array_sort(
        F.flatten(F.collect_list(F.col("new_names")))
    )
    new_names = names.groupBy("subject", "canonical").agg(
        F.collect_list(F.when(F.col("w") == NEW, F.col("name"))).alias("new_names")
    )
    return (
        per_canonical.join(new_names, ["subject", "canonical"])
        .groupBy("subject")
        .agg(
            F.array_sort(F.collect_list(F.struct("canonical", "names"))).alias("entries"),
            new.alias("new_themes"),
        )
        .select(
            "subject",
            F.map_from_entries(
                F.transform(
                    "entries",
                    lambda e: F.struct(
                        e["canonical"],
                        F.concat(
                            e["names"],
                            F.array(F.lit("shared"), F.element_at("entries", 1)["canonical"]),
                        ),
                    ),
                )
            ).alias("resolved"),
            "new_themes",
        )
    )


REGISTRY_RUN = "CASE WHEN length(name) % 2 = 0 THEN 1 ELSE 2 END"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of two earlier runs: every name, in falling order of its first part."""
    names = (
        theme_rows(spark, sf_dir)
        .groupBy("subject", "name")
        .agg(F.min("p_partkey").alias("k"))
        .select("subject", "name", F.expr(CANONICAL).alias("canonical"), F.expr(REGISTRY_RUN).alias("gen"), "k")
    )
    own = names.groupBy("subject", "canonical").agg(F.min("gen").alias("gen"))
    place = {c: F.lit(0).cast("bigint").alias(c) for c in ("part", "c")}

    def ordinal(a: Column) -> Column:
        return F.struct(
            F.col("gen").cast("bigint").alias("gen"), F.lit(0).alias("new"), *place.values(), a.cast("bigint").alias("a")
        ).alias("ordinal")

    return own.select(
        "subject", "canonical", F.lit(None).cast("string").alias("alias"), ordinal(F.lit(-1))
    ).unionByName(names.select("subject", "canonical", F.col("name").alias("alias"), ordinal(1_000_000_000 - F.col("k"))))


THEMES_SQL = other_sql(f"""
themes AS (
  SELECT p_partkey, {THEME_SUBJECT} AS subject, '/in/' || {THEME_SUBJECT} AS folder,
         {THEME_GROUP} AS base_name, {THEME_NAME} AS name,
         CASE WHEN p_size % 4 <> 0 THEN [p_brand, 'size ' || p_size] ELSE [] END AS recall_concepts,
         CASE WHEN p_size % 5 < 2 THEN [p_type || ' problem'] ELSE [] END AS problem_types,
         row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey) - 1 AS theme_no
  FROM part),
names AS (
  SELECT DISTINCT subject, name, {FIRST_WORD} AS w, {CANONICAL} AS canonical FROM themes)""")

ENTRIES_SQL = (
    THEMES_SQL
    + f""",
canon AS (
  SELECT subject, canonical, row_number() OVER (PARTITION BY subject ORDER BY canonical) - 1 AS c,
         first_value(canonical) OVER (PARTITION BY subject ORDER BY canonical) AS head
  FROM (SELECT DISTINCT subject, canonical FROM names)),
listed AS (
  SELECT subject, canonical, name AS alias,
         row_number() OVER (PARTITION BY subject, canonical ORDER BY name) - 1 AS a
  FROM names WHERE w NOT IN ('{FORGOTTEN}', '{NEW}')),
entries AS (
  SELECT subject, canonical, canonical AS alias, 0 AS part, c, -1 AS a FROM canon
  UNION ALL
  SELECT l.subject, l.canonical, l.alias, 0, c.c, l.a FROM listed l JOIN canon c USING (subject, canonical)
  UNION ALL
  SELECT subject, canonical, 'shared', 0, c, 100000 FROM canon
  UNION ALL
  SELECT subject, canonical, head, 0, c, 100001 FROM canon
  UNION ALL
  SELECT subject, name, name, 1, row_number() OVER (PARTITION BY subject ORDER BY name) - 1, -1
  FROM names WHERE w = '{NEW}'),
alias_map AS (
  SELECT subject, alias, arg_max(canonical, part * 1000000000000 + c * 1000000 + a) AS canonical
  FROM entries GROUP BY subject, alias)"""
)

# --- cards, from conversations -----------------------------------------------------

CARD_SUBJECT = "CASE WHEN q.conv_id % 3 = 0 THEN 'Course 0' ELSE 'Course ' || (q.conv_id % 20) END"
CARD_THEME = "'Theme ' || (q.turn {div} 2)"
CARD_KIND = "CASE WHEN q.conv_id % 4 = 0 THEN 'problem' ELSE 'recall' END"
CARD_QUESTION = "CASE WHEN q.conv_id % 6 = 1 THEN ' Question ' || q.turn ELSE '  ' || q.text || chr(10) END"
CARD_ANSWER = "CASE WHEN q.conv_id % 11 = 0 THEN '   ' ELSE a.text END"
CARD_NOTE = "CASE WHEN q.conv_id % 5 = 0 THEN NULL ELSE ' conv ' || q.conv_id || ', turn ' || q.turn END"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it are a card."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").alias("q")
    told = turns.where("role = 'assistant'").alias("a")
    return asked.join(told, F.expr("q.conv_id = a.conv_id AND q.turn + 1 = a.turn")).select(
        "q.conv_id",
        "q.turn",
        F.expr(CARD_SUBJECT).alias("subject"),
        F.expr(spark_sql(CARD_THEME)).alias("theme"),
        F.expr(CARD_KIND).alias("kind"),
        F.expr("q.conv_id * 100 + q.turn").alias("ordinal"),
        F.expr(CARD_QUESTION).alias("question"),
        F.expr(CARD_ANSWER).alias("answer"),
        F.expr(CARD_NOTE).alias("note"),
    )


def decked_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).withColumn(
        "deck", deck_name(F.col("subject"), F.col("theme"), F.col("kind"))
    )


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
# Powers of 62 for the ten upper digits of a base-62 number.
_POWERS = [62**k for k in range(10, -1, -1)]


def guid_sql(deck: str, question: str) -> str:
    number = (
        f"('0x' || sha1(split_part({deck}, '::', 1) || chr(31) || {deck} || chr(31) || {question})[1:16])::UBIGINT"
    )
    text = " || ".join(
        f"substr('{BASE62_DIGITS}', (({number} // {p}::UBIGINT) % 62 + 1)::BIGINT, 1)" for p in _POWERS
    )
    return f"coalesce(nullif(ltrim({text}, 'a'), ''), '0')"


CARDS_SQL = other_sql(f"""
cards AS (
  SELECT *, subject || '::' || theme || CASE WHEN kind = 'problem' THEN '::Problems' ELSE '' END AS deck
  FROM (SELECT q.conv_id, q.turn, {CARD_SUBJECT} AS subject, {CARD_THEME} AS theme, {CARD_KIND} AS kind,
               q.conv_id * 100 + q.turn AS ordinal, {CARD_QUESTION} AS question,
               {CARD_ANSWER} AS answer, {CARD_NOTE} AS note
        FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn
        WHERE q.role = 'user' AND a.role = 'assistant')),
valid AS (
  SELECT * FROM (SELECT conv_id, turn, subject, theme, kind, ordinal, deck,
         trim(question, {BLANKS}) AS question, trim(answer, {BLANKS}) AS answer,
         coalesce(trim(note, {BLANKS}), '') AS note FROM cards)
  WHERE question <> '' AND answer <> ''),
ids AS (
  SELECT *, {guid_sql("deck", "question")} AS guid,
         ('0x' || sha1(left(question, 9))[1:8])::BIGINT AS csum,
         ('0x' || sha1(deck)[1:12])::BIGINT | 140737488355328 AS did FROM valid),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, guid ORDER BY ordinal) AS r
                 FROM ids) WHERE r = 1)""")

FIRST_NOTE_ID = 1_700_000_000_000
NOW_MS = 1_700_000_050_000


def stored(spark: SparkSession, sf_dir: str, which: str = "true") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, cards and decks of an existing store; decks of 'Theme 3' got lost."""
    made = store.with_ids(store.valid_cards(decked_cards(spark, sf_dir).where(which)))
    held = store.first_per_guid(made, F.col("ordinal")).withColumns(
        {
            "nid": F.lit(FIRST_NOTE_ID) + F.col("ordinal"),
            "cid": F.lit(FIRST_NOTE_ID) + F.col("ordinal") + store.CARD_ID_GAP,
            "due": F.col("ordinal") % 1000,
        }
    )
    notes = store.as_notes(held, F.timestamp_millis(F.lit(FIRST_NOTE_ID)))
    known = decked_cards(spark, sf_dir).where("theme <> 'Theme 3'").select("deck")
    return notes, store.as_cards(held), store.deck_table(known)


SNAPSHOT_SQL = (
    CARDS_SQL
    + f""",
snapshot AS (
  SELECT subject, CASE WHEN theme = 'Theme 3' THEN 'Unknown' ELSE deck END AS deck,
         {FIRST_NOTE_ID} + ordinal AS nid, question, answer, note FROM firsts)"""
)
