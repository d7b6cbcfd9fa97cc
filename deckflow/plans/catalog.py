"""Every query over the given tables, and the SQL that must give the same rows.

A query is a function ``(spark, sf_dir) -> DataFrame``. Lists and maps are joined to
text in the last step, so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.functions import answers, ids, text
from deckflow.operators import (
    embedding,
    exports,
    grouping,
    inference,
    ledger,
    neardup,
    report,
    requests,
    store,
    themes,
)
from deckflow.plans import inputs
from deckflow.plans.inputs import other_sql, spark_sql, table
from deckflow.session import materialize, scratch_path, spread
from deckflow.sources import files, parts
from deckflow.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- sources -----------------------------------------------------------------

_RANK = """CASE WHEN name LIKE '%.pdf' THEN 0 WHEN name LIKE '%.pptx' THEN 1
    WHEN name LIKE '%.ppt' THEN 2 WHEN name LIKE '%.md' THEN 3 WHEN name LIKE '%.txt' THEN 4 END"""


@query(f"WITH {inputs.FILES_SQL} SELECT page_id, path, name, {_RANK} AS ext_rank FROM files WHERE {_RANK} IS NOT NULL")
def files_by_extension(spark, sf_dir):
    return files.by_extension(inputs.page_files(spark, sf_dir)).select(
        "page_id", "path", "name", "ext_rank"
    )


@query(f"""WITH {inputs.FILES_SQL} SELECT page_id, path FROM files
    WHERE NOT starts_with(name, '.syncthing') AND NOT starts_with(name, 'syncthing-')
      AND NOT ends_with(name, '.ocr.md')""")
def files_exclude_artifacts(spark, sf_dir):
    return files.without_artifacts(inputs.page_files(spark, sf_dir)).select("page_id", "path")


@query(f"""WITH {inputs.FILES_SQL}, f AS (SELECT *, lower(ext) AS e FROM files)
    SELECT page_id, ext, CASE WHEN e = '.pdf' THEN 'pages' WHEN e IN ('.pptx', '.ppt') THEN 'slides'
             WHEN e IN ('.md', '.txt') THEN 'text' ELSE '' END AS format,
           CASE WHEN e IN ('.pdf', '.pptx', '.ppt', '.md', '.txt') THEN ''
             ELSE 'unsupported: ' || e END AS error FROM f""")
def format_dispatch(spark, sf_dir):
    told = files.with_format(inputs.page_files(spark, sf_dir))
    return told.select(
        "page_id",
        "ext",
        F.coalesce("format", F.lit("")).alias("format"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", files.content_hash(F.encode("text", "UTF-8")).alias("sha256"))


@query("""SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_sha256
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(65533) || 'z' ELSE text END AS t
          FROM documents)""")
def text_decode(spark, sf_dir):
    broken = F.concat(F.encode("text", "UTF-8"), F.expr("X'FF7A'"))
    content = F.when(F.expr("doc_id % 3 = 0"), broken).otherwise(F.encode("text", "UTF-8"))
    decoded = table(spark, sf_dir, "documents").select(
        "doc_id", files.decode_text(content).alias("t")
    )
    return decoded.select(
        "doc_id",
        F.length("t").cast("bigint").alias("n_chars"),
        F.sha2("t", 256).alias("text_sha256"),
    )


@query(other_sql(f"""WITH {inputs.MEMBERS_SQL}
    SELECT folder, base_name, doc_type, path, length(text) AS n_chars FROM members
    WHERE NOT {inputs.DOC_BLANK}"""))
def nonblank_documents(spark, sf_dir):
    docs = inputs.named_documents(spark, sf_dir)
    blank = F.expr(spark_sql(inputs.DOC_BLANK))
    read = docs.withColumn("text", F.when(blank, F.lit(" \t\n")).otherwise(F.col("text")))
    members = grouping.group_files(_groups(docs))
    return grouping.usable_documents(members, read).select(
        "folder", "base_name", "doc_type", "path", F.length("text").cast("bigint").alias("n_chars")
    )


_PART = """CASE (conv_id + turn) % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' || chr(10)
    ELSE chr(9) || text || ' ' END"""


@query(f"""SELECT conv_id, coalesce(string_agg(trim(part, {inputs.BLANKS}), chr(10) || chr(10) ORDER BY turn)
      FILTER (WHERE part <> ''), '') AS text
    FROM (SELECT conv_id, turn, {_PART} AS part FROM conversations) GROUP BY conv_id""")
def assemble_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("part_no"), F.expr(_PART).alias("text")
    )
    return parts.assemble_pages(pages, ["conv_id"])


@query(f"""WITH shapes AS (
      SELECT conv_id, turn, generate_subscripts(s, 1) AS shape_no, unnest(s) AS shape
      FROM (SELECT conv_id, turn, string_split(CASE WHEN turn % 4 = 1 THEN ' ' ELSE text END, '. ') AS s
            FROM conversations)),
    slides AS (
      SELECT conv_id, turn, '[Slide ' || (turn + 1) || ']' || chr(10)
          || string_agg(trim(shape, {inputs.BLANKS}), chr(10) ORDER BY shape_no) AS slide
      FROM shapes WHERE trim(shape, {inputs.BLANKS}) <> '' GROUP BY conv_id, turn)
    SELECT conv_id, string_agg(slide, chr(10) || chr(10) ORDER BY turn) AS text
    FROM slides GROUP BY conv_id""")
def assemble_slides(spark, sf_dir):
    shown = F.when(F.expr("turn % 4 = 1"), F.lit(" ")).otherwise(F.col("text"))
    shapes = table(spark, sf_dir, "conversations").select(
        "conv_id",
        (F.col("turn") + 1).alias("part_no"),
        F.posexplode(F.split(shown, r"\. ")).alias("shape_no", "text"),
    )
    return parts.assemble_slides(shapes, ["conv_id"])


@query(f"""WITH assembled AS (
      SELECT conv_id, coalesce(string_agg(trim(part, {inputs.BLANKS}), chr(10) || chr(10) ORDER BY turn)
        FILTER (WHERE part <> ''), '') AS text
      FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '  ' ELSE text END AS part FROM conversations)
      GROUP BY conv_id)
    SELECT conv_id, coalesce(CASE WHEN trim(a.text, {inputs.BLANKS}) <> '' THEN a.text END,
             trim(d.text, {inputs.BLANKS}), '') AS text
    FROM assembled a LEFT JOIN documents d ON a.conv_id = d.doc_id""")
def sidecar_fallback(spark, sf_dir):
    scanned = F.when(F.expr("conv_id % 3 = 0"), F.lit("  ")).otherwise(F.col("text"))
    pages = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("part_no"), scanned.alias("text")
    )
    sidecars = (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("conv_id"), F.col("text").alias("sidecar"))
    )
    return parts.with_sidecar(parts.assemble_pages(pages, ["conv_id"]), sidecars, ["conv_id"])


# --- ledger ------------------------------------------------------------------

_LEDGER_HASH = "CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha2(text, 256) END"
_LEDGER_ARTIFACT = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'src' || (doc_id {div} 40) || '.apkg' END"


@query(other_sql(f"""WITH {inputs.DOCS_SQL}, now AS (SELECT doc_id, path, sha256(text) AS sha256 FROM docs),
    ledger AS (SELECT path, {_LEDGER_HASH.replace("sha2(text, 256)", "sha256(text)")} AS old, {_LEDGER_ARTIFACT} AS artifact
               FROM docs WHERE doc_id % 5 <> 0),
    present AS (SELECT DISTINCT 'src' || (doc_id {{div}} 40) || '.apkg' AS artifact FROM docs
                WHERE (doc_id {{div}} 40) % 4 <> 0)
    SELECT doc_id, path, sha256, CASE WHEN old IS NULL THEN 'new' WHEN old <> sha256 THEN 'changed'
             ELSE 'artifact_missing' END AS reason
    FROM now LEFT JOIN ledger USING (path)
    WHERE old IS NULL OR old <> sha256
       OR (artifact IS NOT NULL AND artifact NOT IN (SELECT artifact FROM present))"""))
def ledger_pending(spark, sf_dir):
    docs = inputs.named_documents(spark, sf_dir)
    now = docs.select(
        "doc_id", "path", files.content_hash(F.encode("text", "UTF-8")).alias("sha256")
    )
    known = docs.where("doc_id % 5 <> 0").select(
        "path",
        F.expr(_LEDGER_HASH).alias("sha256"),
        F.expr(spark_sql(_LEDGER_ARTIFACT)).alias("artifact"),
    )
    present = docs.where("(doc_id div 40) % 4 <> 0").select(
        F.expr("'src' || (doc_id div 40) || '.apkg'").alias("artifact")
    )
    return ledger.pending_files(now, known, present).select("doc_id", "path", "sha256", "reason")


@query(other_sql(f"""WITH {inputs.MEMBERS_SQL},
    outcome AS (SELECT folder, sum(quality) AS total_added, max(toxic) = 1 AS had_error
                FROM docs JOIN labels USING (doc_id) GROUP BY folder),
    fresh AS (SELECT path, sha256(text) AS sha256, base_name AS themes,
                CASE WHEN total_added > 0 THEN 'in' || replace(folder[5:], ' ', '_') || '.apkg' END AS artifact
              FROM members JOIN outcome USING (folder) WHERE NOT (had_error AND total_added = 0)),
    old AS (SELECT path, 'old' AS sha256, 'before' AS themes, NULL AS artifact FROM docs)
    SELECT path, sha256, themes, coalesce(artifact, '') AS artifact FROM fresh
    UNION ALL
    SELECT path, sha256, themes, '' FROM old WHERE path NOT IN (SELECT path FROM fresh)"""))
def ledger_commit(spark, sf_dir):
    docs = inputs.named_documents(spark, sf_dir)
    members = (
        grouping.group_files(_groups(docs))
        .join(docs.select("path", F.sha2("text", 256).alias("sha256")), "path")
        .select("path", "sha256", F.col("folder").alias("subject"), F.array("base_name").alias("themes"))
    )
    outcome = (
        docs.join(table(spark, sf_dir, "labels"), "doc_id")
        .groupBy(F.col("folder").alias("subject"))
        .agg(F.sum("quality").alias("total_added"), F.bool_or(F.col("toxic") == 1).alias("had_error"))
    )
    new = ledger.committable(members, outcome, text.artifact_name(F.col("subject")))
    old = docs.select(
        "path",
        F.lit("old").alias("sha256"),
        F.array(F.lit("before")).alias("themes"),
        F.lit(None).cast("string").alias("artifact"),
    )
    return ledger.merge_entries(old, new).select(
        "path",
        "sha256",
        F.array_join("themes", "|").alias("themes"),
        F.coalesce("artifact", F.lit("")).alias("artifact"),
    )


# --- grouping and names --------------------------------------------------------


def _groups(docs: DataFrame) -> DataFrame:
    keyed = grouping.with_group_key(docs)
    return grouping.group_documents(keyed, F.struct("ext_rank", "path"))


@query(f"WITH {inputs.DOCS_SQL} SELECT doc_id, stem, base_name FROM docs")
def base_name(spark, sf_dir):
    docs = grouping.with_group_key(inputs.named_documents(spark, sf_dir))
    return docs.select("doc_id", "stem", "base_name")


@query(f"WITH {inputs.DOCS_SQL} SELECT doc_id, stem, doc_type FROM docs")
def doc_type(spark, sf_dir):
    docs = grouping.with_group_key(inputs.named_documents(spark, sf_dir))
    return docs.select("doc_id", "stem", "doc_type")


@query(f"""WITH {inputs.MEMBERS_SQL}
    SELECT folder, base_name, string_agg(doc_type || '=' || path, '|' ORDER BY doc_type) AS files,
           any_value(n) AS n_files
    FROM members JOIN (SELECT folder, base_name, count(*) AS n FROM docs GROUP BY ALL) USING (folder, base_name)
    GROUP BY folder, base_name""")
def document_groups(spark, sf_dir):
    listed = F.transform(
        F.map_entries("files"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return _groups(inputs.named_documents(spark, sf_dir)).select(
        "folder", "base_name", F.array_join(listed, "|").alias("files"), "n_files"
    )


_SUBJECT_FOLDER = f"""CASE WHEN page_id % 5 = 0 THEN '/in' WHEN page_id % 7 = 0 THEN '/elsewhere/My_' || page_id
    ELSE '/in/' || replace({inputs.PAGE_FOLDER}, '.', '_') END"""


@query(f"""SELECT page_id, CASE WHEN folder = '/in' THEN 'Told ' || page_id
        WHEN starts_with(folder, '/in/') THEN array_to_string(
          list_transform(string_split(folder[5:], '/'), lambda s: trim(replace(s, '_', ' '))), '::')
        ELSE replace(regexp_extract(folder, '([^/]+)$', 1), '_', ' ') END AS subject
    FROM (SELECT page_id, {_SUBJECT_FOLDER} AS folder FROM pages)""")
def subject_of_folder(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("folder", F.expr(_SUBJECT_FOLDER))
    told = F.expr("'Told ' || page_id")
    return pages.select(
        "page_id", text.subject_of_folder(F.col("folder"), "/in", told).alias("subject")
    )


@query(f"""SELECT page_id, regexp_replace(trim(regexp_replace(s, '[^\\w\\s-]', '', 'g')), '\\s+', '_', 'g')
      || '.apkg' AS artifact
    FROM (SELECT page_id, replace(replace({inputs.PAGE_FOLDER}, '.', '  '), '/', '::') AS s FROM pages)""")
def artifact_name(spark, sf_dir):
    subject = F.expr(f"replace(replace({inputs.PAGE_FOLDER}, '.', '  '), '/', '::')")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.artifact_name(subject).alias("artifact")
    )


@query(f"""WITH {inputs.CARDS_SQL}, p AS (SELECT DISTINCT string_split(deck, '::') AS s FROM cards),
    n AS (SELECT DISTINCT array_to_string(s[1:k], '::') AS name, k AS depth
          FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM p))
    SELECT ('0x' || sha1(name)[1:12])::BIGINT | 140737488355328 AS did, name,
           CASE WHEN depth > 1 THEN array_to_string(string_split(name, '::')[1:depth - 1], '::') ELSE '' END AS parent,
           depth FROM n""")
def deck_hierarchy(spark, sf_dir):
    decks = store.deck_table(inputs.decked_cards(spark, sf_dir))
    return decks.select("did", "name", F.coalesce("parent", F.lit("")).alias("parent"), *big("depth"))


# --- themes ----------------------------------------------------------------------


@query(f"""WITH {inputs.THEMES_SQL} SELECT subject, count(DISTINCT base_name) AS n_groups, count(*) AS n_proposed
    FROM themes GROUP BY subject""")
def subject_rollup(spark, sf_dir):
    return themes.subject_rollup(inputs.analyses(spark, sf_dir))


@query(f"WITH {inputs.THEMES_SQL} SELECT subject, name FROM names")
def proposed_themes(spark, sf_dir):
    return themes.proposed_themes(inputs.analyses(spark, sf_dir))


def _aliases(spark, sf_dir):
    return themes.alias_map(themes.alias_entries(inputs.resolutions(spark, sf_dir)))


def _resolved(spark, sf_dir, analyses=None):
    """Every proposed name: by alias, and those that no answer lists by the closest canonical."""
    analyses = inputs.analyses(spark, sf_dir) if analyses is None else analyses
    return themes.resolve_themes(themes.proposed_themes(analyses), _aliases(spark, sf_dir))


# Similarity of two texts: twice the letters in common blocks over all letters, where the
# longest common block (the first in a, then in b) parts both texts, again and again.
_RESOLVED_SQL = (
    inputs.ENTRIES_SQL.replace("themes AS (", "RECURSIVE themes AS (", 1)
    + """,
missed AS (SELECT DISTINCT t.subject, t.name FROM themes t ANTI JOIN alias_map m ON t.subject = m.subject AND t.name = m.alias),
pairs AS (
  SELECT row_number() OVER () AS p, subject, name, canonical AS a, name AS b
  FROM missed JOIN (SELECT DISTINCT subject, canonical FROM alias_map) USING (subject)),
cells AS (
  SELECT p, i, j, i - row_number() OVER (PARTITION BY p, j - i ORDER BY i) AS run
  FROM (SELECT p, a, b, i, unnest(range(1, len(b) + 1)) AS j
        FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM pairs)) WHERE a[i] = b[j]),
runs AS (SELECT p, i, j, max(i) OVER (PARTITION BY p, j - i, run) - i + 1 AS n FROM cells),
blocks(p, alo, ahi, blo, bhi, n) AS (
  SELECT p, 1::BIGINT, len(a), 1::BIGINT, len(b), 0::BIGINT FROM pairs
  UNION ALL
  SELECT p, CASE side WHEN 1 THEN alo ELSE best[2] + best[1] END, CASE side WHEN 1 THEN best[2] - 1 ELSE ahi END,
         CASE side WHEN 1 THEN blo ELSE best[3] + best[1] END, CASE side WHEN 1 THEN best[3] - 1 ELSE bhi END,
         CASE side WHEN 1 THEN best[1] ELSE 0 END
  FROM (SELECT k.p, alo, ahi, blo, bhi,
               arg_max([least(r.n, ahi - i + 1, bhi - j + 1), i, j],
                       least(r.n, ahi - i + 1, bhi - j + 1) * 1000000 - i * 1000 - j) AS best
        FROM blocks k JOIN runs r ON k.p = r.p AND i BETWEEN alo AND ahi AND j BETWEEN blo AND bhi
        GROUP BY ALL), (VALUES (1), (2)) sides(side)),
scored AS (
  SELECT subject, name, a AS canonical, 2.0::DOUBLE * total / (len(a) + len(b)) AS ratio
  FROM pairs JOIN (SELECT p, sum(n) AS total FROM blocks GROUP BY p) USING (p)),
resolved AS (
  SELECT DISTINCT t.subject, t.name, m.canonical, 'alias' AS how
  FROM themes t JOIN alias_map m ON t.subject = m.subject AND t.name = m.alias
  UNION ALL
  SELECT subject, name, max((ratio, canonical))[2], 'closest' FROM scored GROUP BY subject, name)"""
)

_ITEMS_SQL = (
    _RESOLVED_SQL
    + """,
items AS (SELECT t.*, r.canonical FROM themes t JOIN resolved r ON t.subject = r.subject AND t.name = r.name)"""
)


def _items(spark, sf_dir):
    analyses = materialize(inputs.analyses(spark, sf_dir), "analyses")
    return themes.theme_items(analyses, _resolved(spark, sf_dir, analyses))


@query(f"""WITH {_ITEMS_SQL} SELECT subject, folder, base_name,
      string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS themes FROM items GROUP BY ALL""")
def group_themes(spark, sf_dir):
    found = themes.group_themes(_items(spark, sf_dir))
    return found.select("subject", "folder", "base_name", F.array_join("themes", "|").alias("themes"))


@query(f"WITH {_ITEMS_SQL} SELECT DISTINCT subject, canonical FROM items")
def subject_themes(spark, sf_dir):
    return themes.subject_canonicals(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS_SQL}, pieces AS (
      SELECT *, 'recall' AS kind, unnest(recall_concepts) AS item, generate_subscripts(recall_concepts, 1) - 1 AS item_no FROM items
      UNION ALL
      SELECT *, 'problem', unnest(problem_types), generate_subscripts(problem_types, 1) - 1 FROM items)
    SELECT subject, canonical, kind, folder, base_name, theme_no, item_no, item FROM pieces""")
def theme_content(spark, sf_dir):
    return themes.theme_pieces(_items(spark, sf_dir)).select(
        "subject", "canonical", "kind", "folder", "base_name", *big("theme_no", "item_no"), "item"
    )


@query(f"WITH {inputs.ENTRIES_SQL} SELECT subject, alias, canonical FROM alias_map")
def alias_map(spark, sf_dir):
    return _aliases(spark, sf_dir)


@query(f"""WITH {inputs.ENTRIES_SQL} SELECT n.subject, n.name, coalesce(m.canonical, '') AS canonical
    FROM (SELECT DISTINCT subject, name FROM themes) n
    LEFT JOIN alias_map m ON n.subject = m.subject AND n.name = m.alias""")
def theme_resolve(spark, sf_dir):
    proposed = themes.proposed_themes(inputs.analyses(spark, sf_dir))
    return themes.lookup_themes(proposed, _aliases(spark, sf_dir)).select(
        "subject", "name", F.coalesce("canonical", F.lit("")).alias("canonical")
    )


@query(f"WITH {_RESOLVED_SQL} SELECT subject, name, canonical, how FROM resolved")
def theme_fuzzy_fallback(spark, sf_dir):
    return _resolved(spark, sf_dir)


_REGISTRY_SQL = f"""
held AS (
  SELECT subject, name, {inputs.CANONICAL} AS canonical, {inputs.REGISTRY_RUN} AS gen, min(p_partkey) AS k
  FROM themes GROUP BY ALL),
old AS (
  SELECT subject, canonical, NULL AS alias, min(gen) AS gen, 0 AS c, -1 AS a FROM held GROUP BY subject, canonical
  UNION ALL SELECT subject, canonical, name, gen, 0, 1000000000 - k FROM held)"""


@query(f"""WITH {inputs.ENTRIES_SQL}, {_REGISTRY_SQL},
    merged AS (
      SELECT * FROM old UNION ALL
      SELECT subject, canonical, CASE WHEN a >= 0 THEN alias END, 3, part * 1000000 + c, a FROM entries),
    firsts AS (SELECT subject, canonical, alias, min((gen, c, a)) AS o FROM merged GROUP BY subject, canonical, alias)
    SELECT subject, canonical, coalesce(string_agg(alias, '|' ORDER BY o), '') AS aliases
    FROM firsts GROUP BY subject, canonical""")
def registry_upsert(spark, sf_dir):
    grown = themes.registry_upsert(
        inputs.registry(spark, sf_dir), inputs.resolutions(spark, sf_dir)
    )
    return themes.registry_aliases(grown).select(
        "subject", "canonical", F.array_join("aliases", "|").alias("aliases")
    )


@query(f"""WITH {inputs.THEMES_SQL}, {_REGISTRY_SQL}
    SELECT subject, canonical, count(alias) AS n_aliases FROM old GROUP BY subject, canonical""")
def registry_themes(spark, sf_dir):
    listed = themes.registry_aliases(inputs.registry(spark, sf_dir))
    return listed.select("subject", "canonical", F.size("aliases").cast("bigint").alias("n_aliases"))


# --- ids and the card store -------------------------------------------------------


def _with_ids(spark, sf_dir):
    return store.with_ids(store.valid_cards(inputs.decked_cards(spark, sf_dir)))


@query(f"WITH {inputs.CARDS_SQL} SELECT conv_id, turn, guid FROM ids")
def stable_guid(spark, sf_dir):
    return _with_ids(spark, sf_dir).select("conv_id", "turn", "guid")


@query(f"WITH {inputs.CARDS_SQL} SELECT conv_id, turn, csum FROM ids")
def checksum(spark, sf_dir):
    return _with_ids(spark, sf_dir).select("conv_id", "turn", "csum")


@query(f"WITH {inputs.CARDS_SQL} SELECT DISTINCT deck, did FROM ids")
def deck_id(spark, sf_dir):
    return _with_ids(spark, sf_dir).select("deck", "did").distinct()


@query(f"""WITH {inputs.CARDS_SQL} SELECT conv_id, turn, question || chr(31) || answer || chr(31) || note AS flds,
      answer AS second, '' AS fourth FROM valid""")
def field_pack(spark, sf_dir):
    packed = store.valid_cards(inputs.decked_cards(spark, sf_dir)).withColumn(
        "flds", ids.pack_fields(F.col("question"), F.col("answer"), F.col("note"))
    )
    return packed.select(
        "conv_id",
        "turn",
        "flds",
        ids.unpack_field(F.col("flds"), 2).alias("second"),
        ids.unpack_field(F.col("flds"), 4).alias("fourth"),
    )


@query(f"WITH {inputs.CARDS_SQL} SELECT conv_id, turn, question, answer, note FROM valid")
def valid_cards(spark, sf_dir):
    valid = store.valid_cards(inputs.decked_cards(spark, sf_dir))
    return valid.select("conv_id", "turn", "question", "answer", "note")


@query(f"WITH {inputs.CARDS_SQL} SELECT conv_id, turn, kind, deck FROM cards")
def cards_union(spark, sf_dir):
    made = inputs.cards(spark, sf_dir)
    recall, problem = made.where("kind = 'recall'"), made.where("kind = 'problem'")
    return store.union_cards(recall.drop("kind"), problem.drop("kind")).select(
        "conv_id", "turn", "kind", "deck"
    )


@query(f"""WITH {inputs.CARDS_SQL} SELECT conv_id, turn,
      trim(coalesce(question, '') || ' ' || coalesce(answer, ''), {inputs.BLANKS}) AS text FROM cards""")
def card_texts(spark, sf_dir):
    made = inputs.cards(spark, sf_dir)
    return made.select("conv_id", "turn", text.card_text(F.col("question"), F.col("answer")).alias("text"))


_STORED = "conv_id % 4 = 1"
_INSERTED_SQL = (
    inputs.CARDS_SQL
    + f""",
inserted AS (
  SELECT * FROM firsts f
  WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.{_STORED} AND i.subject = f.subject AND i.guid = f.guid))"""
)


def _inserted(spark, sf_dir):
    notes, _, _ = inputs.stored(spark, sf_dir, _STORED)
    return store.new_cards(inputs.decked_cards(spark, sf_dir), notes, F.col("ordinal"))


@query(f"WITH {_INSERTED_SQL} SELECT subject, deck, guid, question, answer, note, csum, did FROM inserted")
def card_upsert(spark, sf_dir):
    return _inserted(spark, sf_dir).select(
        "subject", "deck", "guid", "question", "answer", "note", "csum", "did"
    )


@query(f"""WITH {_INSERTED_SQL},
    held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, guid ORDER BY ordinal) AS rr
             FROM ids WHERE {_STORED}) WHERE rr = 1),
    maxima AS (SELECT subject, max({inputs.FIRST_NOTE_ID} + ordinal) AS max_nid, max(ordinal % 1000) AS max_due
               FROM held GROUP BY subject),
    k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY deck, ordinal) - 1 AS k FROM inserted),
    b AS (SELECT k.*, greatest(coalesce(max_nid, 0) + 1, {inputs.NOW_MS}) AS base_nid, max_nid,
                 coalesce(max_due, 0) AS max_due FROM k LEFT JOIN maxima USING (subject))
    SELECT subject, guid, base_nid + k AS nid,
           greatest(coalesce(max_nid + 100000, 0) + 1, base_nid + 100000) + k AS cid, max_due + 1 + k AS due FROM b""")
def card_ids(spark, sf_dir):
    notes, cards, _ = inputs.stored(spark, sf_dir, _STORED)
    numbered = store.assign_ids(
        _inserted(spark, sf_dir), store.store_maxima(notes, cards), F.lit(inputs.NOW_MS)
    )
    return numbered.select("subject", "guid", "nid", "cid", "due")


@query(f"WITH {_INSERTED_SQL} SELECT subject, deck, count(*) AS added FROM inserted GROUP BY ALL")
def added_counts(spark, sf_dir):
    return store.added_counts(_inserted(spark, sf_dir))


def _snapshot(spark, sf_dir):
    return store.card_snapshot(*inputs.stored(spark, sf_dir))


@query(f"WITH {inputs.SNAPSHOT_SQL} SELECT subject, deck, nid, question, answer, note FROM snapshot")
def card_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir)


@query(f"WITH {inputs.SNAPSHOT_SQL} SELECT subject, deck, nid, question FROM snapshot")
def existing_questions(spark, sf_dir):
    return store.existing_questions(_snapshot(spark, sf_dir))


# --- exports ------------------------------------------------------------------------


@query(f"""WITH {inputs.SNAPSHOT_SQL}
    SELECT DISTINCT subject, '' AS deck, 0 AS part, 0::BIGINT AS nid, '# ' || subject AS block FROM snapshot
    UNION ALL SELECT DISTINCT subject, deck, 1, 0, chr(10) || '## ' || deck FROM snapshot
    UNION ALL SELECT subject, deck, 2, nid, chr(10) || '**Q:** ' || question || chr(10) || chr(10) || '**A:** ' || answer
      || CASE WHEN note <> '' THEN chr(10) || chr(10) || '> ' || note ELSE '' END || chr(10) || chr(10) || '---'
    FROM snapshot""")
def export_markdown(spark, sf_dir):
    return exports.markdown_blocks(_snapshot(spark, sf_dir))


def _csv_field(name: str) -> str:
    return f"""CASE WHEN regexp_matches({name}, '[",\\r\\n]') THEN '"' || replace({name}, '"', '""') || '"' ELSE {name} END"""


@query(f"""WITH {inputs.SNAPSHOT_SQL}
    SELECT DISTINCT subject, '' AS deck, 0 AS part, 0::BIGINT AS nid, '{",".join(exports.CSV_COLUMNS)}' AS line FROM snapshot
    UNION ALL SELECT subject, deck, 1, nid,
      {" || ',' || ".join(_csv_field(c) for c in exports.CSV_COLUMNS)} FROM snapshot""")
def export_csv(spark, sf_dir):
    return exports.csv_lines(_snapshot(spark, sf_dir))


# --- answers --------------------------------------------------------------------------

_FENCED = """CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```'
    WHEN 1 THEN '  ' || props || chr(10) ELSE props END"""
# Some answers hold lone backslashes, or those and pairs of them, or end in the midst of lists.
_ODD = """'{"k": ' || (event_id % 1000) || ', "t": ' ||"""
_ANSWER = f"""CASE event_id % 17 WHEN 0 THEN 'no answer'
    WHEN 1 THEN {_ODD} '"' || chr(92) || 'alpha"}}' WHEN 2 THEN {_ODD} '"' || chr(92) || chr(92) || '( ' || chr(92) || 'alpha"}}'
    WHEN 3 THEN {_ODD} '[1, {{"a": "x' WHEN 4 THEN {_ODD} repeat('[', 40) || '"deep' WHEN 5 THEN {_ODD} '{{"a": 1, "b"'
    ELSE {_FENCED} END"""


@query("""SELECT event_id, CASE event_id % 17 WHEN 0 THEN -1 WHEN 1 THEN event_id % 1000 WHEN 2 THEN event_id % 1000 WHEN 3 THEN event_id % 1000
        WHEN 4 THEN event_id % 1000 WHEN 5 THEN event_id % 1000 ELSE (props->>'$.k')::BIGINT END AS k,
      CASE event_id % 17 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 3 ELSE 0 END AS repair FROM events""")
def json_parse(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select(
        "event_id", answers.parse_answer(F.expr(_ANSWER)).alias("p")
    )
    return parsed.select(
        "event_id",
        F.coalesce(F.try_variant_get("p.json", "$.k", "bigint"), F.lit(-1)).alias("k"),
        F.coalesce("p.repair", F.lit(-1)).alias("repair"),
    )


@query(f"""WITH {inputs.CARDS_SQL} SELECT conv_id, turn, question, answer, coalesce(note, '') AS note
    FROM cards WHERE conv_id % 13 <> 0""")
def json_cards(spark, sf_dir):
    card = F.to_json(F.struct("question", "answer", "note"))
    raw = F.when(F.expr("conv_id % 13 = 0"), F.lit('{"other": 1}')).otherwise(
        F.concat(F.lit('```json\n{"flashcards": ['), card, F.lit("]}\n```"))
    )
    parsed = inputs.cards(spark, sf_dir).select(
        "conv_id", "turn", answers.parse_answer(raw)["json"].alias("json")
    )
    return parsed.select("conv_id", "turn", F.inline(answers.cards_of(F.col("json")))).select(
        "conv_id", "turn", "question", "answer", F.coalesce("note", F.lit("")).alias("note")
    )


# --- requests ---------------------------------------------------------------------------

_LABEL_SQL = "CASE doc_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in requests.LABELS.items()
) + " END"


@query(f"""WITH {inputs.MEMBERS_SQL}, p AS (
      SELECT *, unnest(range(0, greatest(ceil(length(text) / 8000)::BIGINT, 1))) AS part FROM members)
    SELECT folder, base_name, part, string_agg('=== ' || {_LABEL_SQL} || ' — ' || name || ' ===' || chr(10)
        || substr(text, part * 8000 + 1, 8000), chr(10) || chr(10) ORDER BY ext_rank, path) AS prompt
    FROM p GROUP BY ALL""")
def analysis_requests(spark, sf_dir):
    docs = inputs.named_documents(spark, sf_dir)
    members = grouping.group_files(_groups(docs)).join(
        docs.select("path", "name", "text", "ext_rank"), "path"
    )
    return requests.analysis_requests(members, "ext_rank", "path").select(
        "folder", "base_name", *big("part"), "prompt"
    )


# Small requests, so that most keys take several.
_FEW = 6
_PART_SQL = "('0x' || md5({0})[1:8])::BIGINT % {1}"


@query(f"""WITH {inputs.THEMES_SQL}, {_REGISTRY_SQL},
    rows AS (SELECT subject, name, true AS new FROM names
             UNION ALL SELECT DISTINCT subject, canonical, false FROM old WHERE subject IN (SELECT subject FROM names)),
    dealt AS (SELECT subject, parts, {_PART_SQL.format("name", "parts")} AS part, name, new FROM rows
              JOIN (SELECT subject, ceil(count(*) / {_FEW})::BIGINT AS parts FROM rows GROUP BY subject) USING (subject)),
    lists AS (SELECT subject, parts, part, new, '["' || string_agg(name, '","' ORDER BY name) || '"]' AS names
              FROM dealt GROUP BY subject, parts, part, new)
    SELECT a.subject, a.part + coalesce(k.part, 0) * a.parts AS part,
      '{requests.SUBJECT}' || a.subject || chr(10) || chr(10) || '{requests.EXISTING_THEMES}' || chr(10)
      || coalesce(k.names, '{requests.NO_THEMES}') || chr(10) || chr(10) || '{requests.PROPOSED_THEMES}'
      || chr(10) || a.names || chr(10) || chr(10) || '{requests.RESOLVE}' AS prompt
    FROM lists a LEFT JOIN (FROM lists WHERE NOT new) k USING (subject) WHERE a.new""")
def resolution_requests(spark, sf_dir):
    proposed = themes.proposed_themes(inputs.analyses(spark, sf_dir))
    return requests.resolution_requests(proposed, inputs.registry(spark, sf_dir), items=_FEW)


# Decks of the card store are given to the themes of the same number.
def _card_request_sql(column: str, heading: str, again: str, closing: str, how: str, suffix: str) -> str:
    return f"""WITH {_ITEMS_SQL},
    t AS (SELECT DISTINCT subject, canonical FROM items),
    pieces AS (SELECT subject, canonical, folder, base_name, theme_no, unnest({column}) AS item,
                      generate_subscripts({column}, 1) AS item_no FROM items),
    bullets AS (SELECT subject, canonical, parts, {_PART_SQL.format("(folder || '/' || base_name)", "parts")} AS part,
                  string_agg('- ' || item, chr(10) ORDER BY folder, base_name, theme_no, item_no) AS bullets
                FROM pieces JOIN (SELECT subject, canonical, ceil(count(*) / {_FEW})::BIGINT AS parts FROM pieces GROUP BY ALL)
                  USING (subject, canonical) GROUP BY ALL),
    old AS (SELECT subject, canonical || '{suffix}' AS theme, 'About ' || base_name AS question, p_partkey FROM items),
    asked AS (SELECT subject, theme, lists, {_PART_SQL.format("question", "lists")} AS list,
                '["' || string_agg(question, '","' ORDER BY p_partkey) || '"]' AS asked
              FROM old JOIN (SELECT subject, theme, ceil(count(*) / {_FEW})::BIGINT AS lists FROM old GROUP BY ALL)
                USING (subject, theme) GROUP BY ALL)
    SELECT t.subject, t.canonical, coalesce(part, 0) + coalesce(list, 0) * coalesce(parts, 1) AS part,
      t.subject || '::' || t.canonical || '{suffix}' AS deck,
      '{requests.SUBJECT}' || t.subject || chr(10) || '{requests.THEME}' || t.canonical || chr(10) || chr(10)
      || '{heading}' || chr(10) || coalesce(bullets, '') || chr(10)
      || coalesce(chr(10) || '{again}' || chr(10) || asked || chr(10), '')
      || chr(10) || '{closing}' AS prompt
    FROM t {how} JOIN bullets b ON t.subject = b.subject AND t.canonical = b.canonical
    LEFT JOIN asked a ON t.subject = a.subject AND t.canonical || '{suffix}' = a.theme"""


def _asked_before(items, suffix: str) -> DataFrame:
    """Earlier questions on the themes, as the store would list them."""
    held = items.select(
        "subject",
        F.concat_ws("::", "subject", "canonical", *([F.lit(suffix)] if suffix else [])).alias("deck"),
        F.expr("4 * int(substr(base_name, 5)) + theme_no").cast("bigint").alias("nid"),
        F.concat(F.lit("About "), "base_name").alias("question"),
    )
    return store.existing_questions(held)


@query(_card_request_sql(
    "recall_concepts", requests.RECALL_ITEMS, requests.RECALL_ASKED, requests.RECALL_CLOSING, "LEFT", ""))
def recall_requests(spark, sf_dir):
    items = materialize(_items(spark, sf_dir), "items")
    return requests.recall_requests(
        themes.subject_canonicals(items),
        themes.theme_content(items, "recall_concepts"),
        _asked_before(items, ""),
        items=_FEW,
    )


@query(_card_request_sql(
    "problem_types", requests.PROBLEM_ITEMS, requests.PROBLEM_ASKED, requests.PROBLEM_CLOSING, "INNER", "::Problems"))
def problem_requests(spark, sf_dir):
    items = materialize(_items(spark, sf_dir), "items")
    return requests.problem_requests(
        themes.subject_canonicals(items),
        themes.theme_content(items, "problem_types"),
        _asked_before(items, "Problems"),
        items=_FEW,
    )


# --- inference and reports ------------------------------------------------------------------


def offline_answer(stage: str, prompt: str) -> dict:
    """A stand-in for a hosted model: always the same answer to the same prompt."""
    if len(prompt) % 7 == 0:
        raise ValueError("refused")
    raw = f'{{"chars": {len(prompt)}}}'
    return {"raw": raw, "prompt_tokens": len(prompt), "completion_tokens": len(raw)}


_ANSWERED_SQL = """
p AS (SELECT DISTINCT text FROM documents),
answered AS (
  SELECT sha256('analysis' || chr(31) || text) AS request_hash, text, length(text) % 7 = 0 AS refused,
         '{"chars": ' || length(text) || '}' AS raw FROM p)"""


@query(f"""WITH {_ANSWERED_SQL}
    SELECT request_hash, CASE WHEN refused THEN '' ELSE raw END AS raw,
      CASE WHEN refused THEN 0 ELSE length(text) END AS prompt_tokens,
      CASE WHEN refused THEN 0 ELSE length(raw) END AS completion_tokens, 0::BIGINT AS total_tokens,
      CASE WHEN refused THEN 'ValueError: refused' ELSE '' END AS error FROM answered""")
def inference_stage(spark, sf_dir):
    prompts = table(spark, sf_dir, "documents").select(F.col("text").alias("prompt"))
    asked = requests.as_requests(prompts, "analysis")
    told = inference.cached_inference(asked, scratch_path(spark, "responses"), offline_answer)
    return told.select(
        "request_hash",
        F.coalesce("raw", F.lit("")).alias("raw"),
        *report.COUNTS,
        F.coalesce("error", F.lit("")).alias("error"),
    )


_STAGE_USAGE = "CASE WHEN doc_id % 10 = {k} THEN NULL ELSE n_chars {div} {k} END"


@query(other_sql("WITH u AS (" + " UNION ALL ".join(
    "SELECT source AS subject, " + _STAGE_USAGE.replace("{k}", str(k)) + f" AS p, {k} AS c FROM documents"
    for k in (2, 3, 5)) + """)
    SELECT subject, sum(coalesce(p, 0))::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens,
           sum(coalesce(p, 0) + c)::BIGINT AS total_tokens FROM u GROUP BY subject"""))
def token_usage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = [
        docs.select(
            F.col("source").alias("subject"),
            F.expr(spark_sql(_STAGE_USAGE.replace("{k}", str(k)))).alias("prompt_tokens"),
            F.lit(k).cast("bigint").alias("completion_tokens"),
        ).withColumn("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.col("completion_tokens"))
        for k in (2, 3, 5)
    ]
    return report.token_usage(*stages)


@query("""WITH d AS (SELECT 'Course ' || source || ' (' || lang || ')' AS subject, quality, toxic
                     FROM documents JOIN labels USING (doc_id))
    SELECT subject, CASE WHEN sum(quality) > 0 THEN replace(replace(replace(subject, '(', ''), ')', ''), ' ', '_') || '.apkg' ELSE '' END AS artifact,
           sum(quality)::BIGINT AS total_added, max(toxic) = 1 AS had_error FROM d GROUP BY subject""")
def run_outcome(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    subject = F.concat(F.lit("Course "), "source", F.lit(" ("), "lang", F.lit(")"))
    built = labelled.select(subject.alias("subject"), (F.col("toxic") == 1).alias("errored"))
    added = (
        labelled.where("quality = 1").groupBy(subject.alias("subject")).agg(F.count("*").alias("added"))
    )
    told = report.run_outcome(built, added, text.artifact_name(F.col("subject")))
    return told.withColumn("artifact", F.coalesce("artifact", F.lit("")))


@query(f"""WITH {inputs.MEMBERS_SQL}, {_INSERTED_SQL}
    SELECT 'files' AS measure, count(*) AS n FROM docs UNION ALL SELECT 'grouped files', count(*) FROM members
    UNION ALL SELECT 'groups', count(*) FROM (SELECT DISTINCT folder, base_name FROM members)
    UNION ALL SELECT 'superseded files', (SELECT count(*) FROM docs) - (SELECT count(*) FROM members)
    UNION ALL SELECT 'cards', count(*) FROM cards UNION ALL SELECT 'valid cards', count(*) FROM valid
    UNION ALL SELECT 'added', count(*) FROM inserted""")
def run_report(spark, sf_dir):
    docs = inputs.named_documents(spark, sf_dir)
    groups = _groups(docs)
    members = grouping.group_files(groups)
    made = inputs.decked_cards(spark, sf_dir)
    return report.run_report(
        **{
            "files": docs,
            "grouped files": members,
            "groups": groups,
            "superseded files": docs.join(members, "path", "left_anti"),
            "cards": made,
            "valid cards": store.valid_cards(made),
            "added": _inserted(spark, sf_dir),
        }
    )


@query(f"""WITH {inputs.FILES_SQL} SELECT page_id, CASE WHEN lower(ext) = '.html' THEN 'quarantine' ELSE 'ok' END AS state,
      CASE WHEN lower(ext) = '.html' THEN 'unsupported: .html' ELSE '' END AS error FROM files""")
def quarantine_split(spark, sf_dir):
    told = files.with_format(inputs.page_files(spark, sf_dir))
    ok, bad = inference.quarantine(told, F.col("error"))
    return ok.select("page_id", F.lit("ok").alias("state"), F.lit("").alias("error")).unionByName(
        bad.select("page_id", F.lit("quarantine").alias("state"), "error")
    )


# --- near-duplicates ---------------------------------------------------------------------------

_TERMS_SQL = r"""
posts AS (
  SELECT id, block, term, count(*) AS n FROM (
    SELECT doc_id AS id, lang AS block, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+')) AS term FROM documents)
  WHERE term <> '' GROUP BY ALL),
squares AS (SELECT id, block, sum(n * n)::BIGINT AS square FROM posts GROUP BY ALL)"""

# Zero is the cosine of texts without a common term; the others reach the threshold in whole numbers.
_TEXT_EDGES_SQL = (
    _TERMS_SQL
    + """,
dots AS (
  SELECT a.id AS i, b.id AS j, sum(a.n * b.n)::HUGEINT AS dot
  FROM posts a JOIN posts b ON a.block = b.block AND a.term = b.term AND a.id < b.id GROUP BY a.id, b.id),
near AS (
  SELECT i, j, dot::DOUBLE / sqrt(a.square::DOUBLE * b.square) AS similarity,
         dot * dot * 625 >= a.square::HUGEINT * b.square * 484 AS close
  FROM dots JOIN squares a ON a.id = i JOIN squares b ON b.id = j),
edges AS (SELECT i, j, similarity FROM near WHERE close)"""
)
_VECTOR_EDGES_SQL = """
vectors AS (SELECT vec_id AS id, label AS block, embedding::DOUBLE[] AS v,
                   sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
edges AS (
  SELECT a.id AS i, b.id AS j, list_dot_product(a.v, b.v) / (a.norm * b.norm) AS similarity
  FROM vectors a JOIN vectors b ON a.block = b.block AND a.id < b.id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.3)"""


def _walk(edges: str) -> str:
    """The sequential scan: one row after the other, kept unless a kept one is close."""
    return f"""WITH RECURSIVE {edges},
nodes AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT i AS id FROM edges UNION SELECT j FROM edges)),
before AS MATERIALIZED (SELECT j AS id, list(i) AS earlier FROM edges GROUP BY j),
steps AS MATERIALIZED (SELECT n, id, coalesce(earlier, []) AS earlier FROM nodes LEFT JOIN before USING (id)),
walk AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS kept
  UNION ALL
  SELECT s.n, CASE WHEN list_has_any(w.kept, s.earlier) THEN w.kept ELSE list_append(w.kept, s.id) END
  FROM walk w JOIN steps s ON s.n = w.n + 1),
kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)),
drops AS (SELECT j AS id, min(i) AS kept_id FROM edges WHERE i IN (SELECT id FROM kept) GROUP BY j)"""


@query(f"""WITH {_TERMS_SQL} SELECT p.id AS doc_id, term, round(n / sqrt(square::DOUBLE), 9) AS weight
    FROM posts p JOIN squares USING (id)""")
def embed_terms(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counted = neardup.counted_terms(docs, "text")
    return counted.select("doc_id", "square", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        "doc_id", F.col("t.terms").alias("term"), F.round(F.col("t.counts") / F.sqrt(F.col("square").cast("double")), 9).alias("weight")
    )


def refusing_embedder(texts: list[str]) -> list[list[float]]:
    """A stand-in for a hosted model that refuses some texts."""
    if any(t.startswith("T") for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count("e"))] for t in texts]


def local_embedder(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" ")), float(t.count("."))] for t in texts]


@query("""WITH refused AS (SELECT DISTINCT source FROM documents WHERE starts_with(text, 'T'))
    SELECT doc_id, CASE WHEN source IN (SELECT source FROM refused) THEN 1 ELSE 0 END AS model,
      CASE WHEN source IN (SELECT source FROM refused)
        THEN length(text) || ',' || (length(text) - length(replace(text, ' ', ''))) || ',' || (length(text) - length(replace(text, '.', '')))
        ELSE length(text) || ',' || (length(text) - length(replace(text, 'e', ''))) END AS vec
    FROM documents""")
def embed_stage(spark, sf_dir):
    made = embedding.embed_texts(
        table(spark, sf_dir, "documents"), "doc_id", "source", "text",
        [refusing_embedder, local_embedder],
    )
    whole = F.array_join(F.transform("vec", lambda x: x.cast("bigint").cast("string")), ",")
    return made.select(F.col("id").alias("doc_id"), "model", whole.alias("vec"))


def _text_drops(spark, sf_dir, **options):
    docs = table(spark, sf_dir, "documents")
    return neardup.text_drops(docs, "doc_id", "lang", "text", **options)


@query(f"""{_walk(_TEXT_EDGES_SQL)}
    SELECT d.id AS doc_id, d.kept_id, round(e.similarity, 6) AS similarity
    FROM drops d JOIN edges e ON e.i = d.kept_id AND e.j = d.id""")
def neardup_pairs_text(spark, sf_dir):
    return _text_drops(spark, sf_dir).select(
        F.col("id").alias("doc_id"), "kept_id", F.round("similarity", 6).alias("similarity")
    )


@query(f"""{_walk(_TEXT_EDGES_SQL)}
    SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT id FROM drops)""")
def neardup_keep_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return neardup.keep(docs, _text_drops(spark, sf_dir), "doc_id").select("doc_id", "lang")


def _vector_drops(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return neardup.vector_drops(rows, "vec_id", "label", "embedding", threshold=0.3)


@query(f"""{_walk(_VECTOR_EDGES_SQL)}
    SELECT d.id AS vec_id, d.kept_id, round(e.similarity, 6) AS similarity
    FROM drops d JOIN edges e ON e.i = d.kept_id AND e.j = d.id""")
def neardup_pairs_vec(spark, sf_dir):
    return _vector_drops(spark, sf_dir).select(
        F.col("id").alias("vec_id"), "kept_id", F.round("similarity", 6).alias("similarity")
    )


@query(f"""{_walk(_VECTOR_EDGES_SQL)}
    SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM drops)""")
def neardup_keep_vec(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return neardup.keep(rows, _vector_drops(spark, sf_dir), "vec_id").select("vec_id", "label")


def offline_confirmation(stage: str, prompt: str) -> dict:
    """Says no, or nothing at all, to some pairs, by the length of the request."""
    if len(prompt) % 5 == 0:
        raise ValueError("no answer")
    return {"raw": '{"redundant": %s}' % ("false" if len(prompt) % 3 == 0 else "true")}


# Characters of a confirmation request beside those of its four texts.
_PROMPT_LENGTH = len(requests.CONFIRM_FORM.format("", "", "", ""))


@query(f"""{_walk(_TEXT_EDGES_SQL.replace("edges AS (SELECT i, j, similarity FROM near WHERE close)", f'''
edges AS (
  SELECT i, j, similarity FROM near JOIN documents a ON a.doc_id = i JOIN documents b ON b.doc_id = j
  WHERE close AND ((a.text = b.text AND a.source = b.source)
    OR ((length(a.text) + length(b.text) + length(a.source) + length(b.source) + {_PROMPT_LENGTH}) % 3 <> 0
    AND (length(a.text) + length(b.text) + length(a.source) + length(b.source) + {_PROMPT_LENGTH}) % 5 <> 0)))'''))}
    SELECT id AS doc_id, kept_id FROM drops""")
def neardup_confirm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cards = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("question"), F.col("text").alias("answer")
    )
    confirm = inference.confirm_pairs(
        cards, scratch_path(spark, "confirmations"), offline_confirmation
    )
    drops = _text_drops(spark, sf_dir, confirm=confirm, content=("source", "text"))
    return drops.select(F.col("id").alias("doc_id"), "kept_id")


# --- incremental runs ------------------------------------------------------------------------------


@query(f"""WITH c AS (
      SELECT event_id, 'Day ' || (user_id % 30) AS deck, event_type || ' by ' || user_id AS question, props AS answer,
             CASE WHEN extract(day FROM ts) <= 10 THEN 0 WHEN extract(day FROM ts) <= 20 THEN 1 ELSE 2 END AS arrival
      FROM events),
    g AS (SELECT *, {inputs.guid_sql("deck", "question")} AS guid FROM c)
    SELECT deck, guid, question, arg_min(answer, arrival * 1000000000000 + event_id) AS answer
    FROM g GROUP BY deck, guid, question""")
def incremental_run(spark, sf_dir):
    return incremental.replay_events(spark, sf_dir)
