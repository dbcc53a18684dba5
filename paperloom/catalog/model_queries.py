"""Prompts, model calls, summaries, drafts, the whole review."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.document_queries import (
    DOC_CHUNKS,
    INGEST_SQL,
    document_lines,
    ingest_markers,
    paper_chunks,
    paper_fetches,
)
from paperloom.catalog.fixtures import PAPER_VIEW, documents, joined, paper_view, sql_chunks, table
from paperloom.catalog.registry import query
from paperloom.catalog.search_queries import (
    APA_SQL,
    AUTHOR_NAMES_SQL,
    BIBTEX_SQL,
    BYLINE_SQL,
    PER_RESPONSE,
    SOURCE_LABEL_SQL,
    first_wins_sql,
    payload_rejects,
    rejects_sql,
)
from paperloom.catalog.stubs import draft_stub, entity_stub, summary_stub
from paperloom.functions.text import clean_names
from paperloom.operators.answers import answer_prompts, create_answers
from paperloom.operators.drafts import asked_ids, draft_included, draft_inputs, draft_members, draft_skipped, related_work_draft
from paperloom.operators.model import (
    DRAFT_INSTRUCTIONS,
    ENTITY_INSTRUCTIONS,
    SUMMARY_INSTRUCTIONS,
    call_model,
    entity_prompt,
    parse_responses,
    summary_cards,
    summary_prompt,
)
from paperloom.operators.views import summary_with_paper
from paperloom.plans.review import literature_review
from paperloom.plans.summarize import prompts_for, summarize_papers
from paperloom.schemas import CHUNK_OVERLAP, CHUNK_SIZE, ENTITY_CHUNKS, SUMMARY_CHUNKS, SUMMARY_FIELDS
from paperloom.session import cut_lineage, fresh_path


def sql_prompts(name: str, instructions: str, heading: str, limit: int, papers: str = "paper_view", chunks: str = "chunks") -> str:
    return f"""{name} AS (
    SELECT paper_id, '{instructions}' || chr(10) || 'Title: ' || title || chr(10) || '{heading}' || chr(10) || texts AS prompt
    FROM {papers} JOIN (
        SELECT paper_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS texts FROM {chunks}
        WHERE chunk_index < {limit} GROUP BY paper_id) USING (paper_id))"""


SUMMARY_PROMPTS = sql_prompts("summary_prompts", SUMMARY_INSTRUCTIONS, "Passages:", SUMMARY_CHUNKS)
ENTITY_PROMPTS = sql_prompts("entity_prompts", ENTITY_INSTRUCTIONS, "Passage:", ENTITY_CHUNKS)


@query("summary_prompt", f"WITH {DOC_CHUNKS}, {SUMMARY_PROMPTS} SELECT * FROM summary_prompts")
def _summary_prompt(spark, sf_dir):
    return prompts_for(paper_view(spark, sf_dir), paper_chunks(spark, sf_dir), summary_prompt, SUMMARY_CHUNKS)


@query("entity_prompt", f"WITH {DOC_CHUNKS}, {ENTITY_PROMPTS} SELECT * FROM entity_prompts")
def _entity_prompt(spark, sf_dir):
    return prompts_for(paper_view(spark, sf_dir), paper_chunks(spark, sf_dir), entity_prompt, ENTITY_CHUNKS)


_CALLED = f"""WITH {DOC_CHUNKS}, {SUMMARY_PROMPTS}
    SELECT paper_id, CASE WHEN length(prompt) % 11 = 0 THEN 'model unavailable' END AS error,
           CASE WHEN length(prompt) % 11 = 0 THEN NULL WHEN length(prompt) % 7 = 0 THEN 'not json'
                WHEN length(prompt) % 5 = 0
                THEN '{{"tldr": "only", "problem": "", "method_explained": 5, "key_results": null}}'
                ELSE '{{"tldr": "digest ' || md5(prompt) || '", "problem": "' || length(prompt)
                     || ' characters", "method_explained": "hashing", "key_results": "' || substr(md5(prompt), 1, 8)
                     || '", "limitations": "none"}}' END AS raw_response
    FROM summary_prompts"""


@query("model_call", _CALLED)
def _model_call(spark, sf_dir):
    return call_model(_summary_prompt(spark, sf_dir), summary_stub, ["paper_id"]).drop("latency_ms")


@query("model_call_reused", _CALLED)
def _model_call_reused(spark, sf_dir):
    """Two runs over one table of answers: some of the papers, then all of them."""
    prompts = cut_lineage(_summary_prompt(spark, sf_dir))
    path = fresh_path(spark, "answers")
    create_answers(spark, path)
    answer_prompts(prompts.where(F.pmod(F.xxhash64("paper_id"), F.lit(3)) == 0), summary_stub, ["paper_id"], path)
    return answer_prompts(prompts, summary_stub, ["paper_id"], path).drop("reused")


def parsed_sql(prompts: str) -> str:
    return f"""parsed AS (
    SELECT paper_id,
           CASE WHEN length(prompt) % 11 = 0 THEN 'model unavailable'
                WHEN length(prompt) % 7 = 0 THEN 'response is not a JSON object'
                WHEN length(prompt) % 5 = 0 THEN 'missing fields: problem, method_explained, key_results, limitations'
           END AS message,
           message IS NULL AS ok,
           CASE WHEN ok THEN 'digest ' || md5(prompt)
                WHEN message LIKE 'missing%' THEN 'only' END AS tldr,
           CASE WHEN ok THEN length(prompt) || ' characters' WHEN message LIKE 'missing%' THEN '' END AS problem,
           CASE WHEN ok THEN 'hashing' END AS method_explained,
           CASE WHEN ok THEN substr(md5(prompt), 1, 8) END AS key_results,
           CASE WHEN ok THEN 'none' END AS limitations
    FROM {prompts})"""


@query(
    "parse_response",
    f"""WITH {DOC_CHUNKS}, {SUMMARY_PROMPTS}, {parsed_sql("summary_prompts")}
    SELECT paper_id, message, ok, {", ".join(SUMMARY_FIELDS)} FROM parsed""",
)
def _parse_response(spark, sf_dir):
    return parse_responses(call_model(_summary_prompt(spark, sf_dir), summary_stub, ["paper_id"]))


@query(
    "clean_entities",
    """WITH words AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    stripped AS (SELECT DISTINCT doc_id, trim(line) AS name FROM words WHERE trim(line) <> '')
    SELECT doc_id, coalesce(string_agg(name, '|' ORDER BY name), '') AS names
    FROM documents LEFT JOIN stripped USING (doc_id) GROUP BY doc_id""",
)
def _clean_entities(spark, sf_dir):
    """Lines of a document as names given by a model, with repeats and outer blanks."""
    given = F.split(F.regexp_replace("text", "\n", " \n "), "\n")
    return documents(spark, sf_dir).select("doc_id", joined(clean_names(given)).alias("names"))


# The draft and card queries use one summary per paper that the stub answered in full.
CARDS = f"""{DOC_CHUNKS}, {SUMMARY_PROMPTS}, {parsed_sql("summary_prompts")}, {AUTHOR_NAMES_SQL},
cards AS (
    SELECT paper_id, doc_id, {", ".join(SUMMARY_FIELDS)}, {APA_SQL} AS citation_apa, {BIBTEX_SQL} AS citation_bibtex
    FROM parsed JOIN paper_view USING (paper_id) LEFT JOIN author_names USING (doc_id) WHERE ok)"""


def cards(spark, sf_dir):
    return summary_cards(_parse_response(spark, sf_dir), paper_view(spark, sf_dir))


@query("summary_card", f"WITH {CARDS} SELECT * EXCLUDE (doc_id) FROM cards")
def _summary_card(spark, sf_dir):
    return cards(spark, sf_dir)


@query(
    "summary_with_paper",
    f"""WITH {CARDS} SELECT c.paper_id, tldr, title, {SOURCE_LABEL_SQL} AS source_label, {BYLINE_SQL} AS byline
    FROM cards c JOIN paper_view USING (paper_id)""",
)
def _summary_with_paper(spark, sf_dir):
    return summary_with_paper(cards(spark, sf_dir).select("paper_id", "tldr"), paper_view(spark, sf_dir))


def draft_sets(spark, sf_dir):
    """Two requests per document as id lists: its neighbours, one of them twice, and an unknown id."""
    return paper_view(spark, sf_dir).select(
        F.col("doc_id").alias("set_id"),
        F.concat_ws(
            ",",
            F.col("paper_id"),
            F.concat(F.lit(" unknown_"), F.col("doc_id").cast("string"), F.lit(" ")),
            F.lag("paper_id").over(_by_response()),
            F.lit(" "),
            F.lead("paper_id").over(_by_response()),
            F.col("paper_id"),
        ).alias("paper_ids"),
    )


def _by_response():
    from pyspark.sql import Window as W

    return W.partitionBy(F.floor(F.col("doc_id") / 16)).orderBy("doc_id")


DRAFTS = f"""{CARDS}, draft_ids AS (
    SELECT doc_id AS set_id,
           list_filter([paper_id, 'unknown_' || doc_id, lag(paper_id) OVER w, lead(paper_id) OVER w, paper_id],
                       lambda x: x IS NOT NULL) AS ids
    FROM paper_view WINDOW w AS (PARTITION BY doc_id // 16 ORDER BY doc_id)),
asked AS (
    SELECT set_id, unnest(ids) AS paper_id, unnest(generate_series(0, len(ids) - 1)) AS pos FROM draft_ids),
members AS (
    SELECT a.set_id, a.pos, a.paper_id, c.paper_id IS NOT NULL AS included,
           '(' || coalesce(list_filter(regexp_split_to_array(p.authors[1], '\\s+'), lambda x: x <> '')[-1], 'Unknown') || ', '
               || coalesce(CAST(year(p.published_date) AS VARCHAR), 'n.d.') || ') ' || p.title || ': ' || c.tldr AS note,
           c.citation_bibtex AS reference
    FROM asked a LEFT JOIN cards c ON c.paper_id = a.paper_id LEFT JOIN paper_view p ON p.paper_id = a.paper_id),
inputs AS (
    SELECT set_id, coalesce(string_agg(note, chr(10) ORDER BY pos) FILTER (WHERE included), '') AS notes,
           coalesce(string_agg(reference, '|' ORDER BY pos) FILTER (WHERE included), '') AS bibtex_references,
           coalesce(string_agg(paper_id, '|' ORDER BY pos) FILTER (WHERE NOT included), '') AS skipped_paper_ids
    FROM members GROUP BY set_id)"""


def members(spark, sf_dir):
    asked = asked_ids(draft_sets(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))
    return draft_members(asked, cards(spark, sf_dir), paper_view(spark, sf_dir))


@query("draft_included", f"WITH {DRAFTS} SELECT set_id, pos, paper_id, note, reference FROM members WHERE included")
def _draft_included(spark, sf_dir):
    return draft_included(members(spark, sf_dir))


@query("draft_skipped", f"WITH {DRAFTS} SELECT set_id, pos, paper_id FROM members WHERE NOT included")
def _draft_skipped(spark, sf_dir):
    return draft_skipped(members(spark, sf_dir))


def _listed(frame):
    return frame.withColumns({name: joined(name) for name in ("bibtex_references", "skipped_paper_ids")})


@query("related_work_input", f"WITH {DRAFTS} SELECT * FROM inputs")
def _related_work_input(spark, sf_dir):
    return _listed(draft_inputs(members(spark, sf_dir)))


@query(
    "related_work_draft",
    f"""WITH {DRAFTS}, prompts AS (
        SELECT *, '{DRAFT_INSTRUCTIONS}' || chr(10) || 'Notes:' || chr(10) || notes AS prompt FROM inputs)
    SELECT set_id, bibtex_references, skipped_paper_ids,
           CASE WHEN notes <> '' AND length(prompt) % 11 <> 0 AND length(prompt) % 7 <> 0 AND length(prompt) % 5 <> 0
                THEN 'see ' || md5(prompt) ELSE '' END AS paragraph
    FROM prompts""",
)
def _related_work_draft(spark, sf_dir):
    return _listed(related_work_draft(members(spark, sf_dir), draft_stub))


# Papers labelled with quality 0 were summarised before, papers without a PDF have no chunks, benchmark ids are unknown.
SUMMARIZE_SQL = f"""{PAPER_VIEW},
chunked_text AS (SELECT paper_id, abstract AS text FROM paper_view WHERE coalesce(pdf_url, '') <> ''),
{sql_chunks("chunked_text", "paper_id", CHUNK_SIZE, CHUNK_OVERLAP)},
done AS (SELECT paper_id FROM paper_view JOIN labels USING (doc_id) WHERE quality = 0),
todo AS (SELECT * FROM paper_view WHERE paper_id NOT IN (SELECT paper_id FROM done)),
{sql_prompts("summary_prompts", SUMMARY_INSTRUCTIONS, "Passages:", SUMMARY_CHUNKS, "todo")},
{parsed_sql("summary_prompts")},
summary_log AS (
    SELECT p.paper_id,
           CASE WHEN p.paper_id IN (SELECT paper_id FROM done) THEN 'already_cached'
                WHEN p.paper_id NOT IN (SELECT paper_id FROM chunks) THEN 'no_chunks_available'
                WHEN NOT ok THEN 'llm_failed' ELSE 'success' END AS status,
           message
    FROM paper_view p LEFT JOIN parsed USING (paper_id)
    UNION ALL SELECT 'item_' || item_id, 'not_ingested', NULL FROM benchmark),
indexed AS (
    SELECT * FROM paper_view
    WHERE paper_id IN (SELECT paper_id FROM summary_log WHERE status IN ('already_cached', 'success'))),
{sql_prompts("entity_prompts", ENTITY_INSTRUCTIONS, "Passage:", ENTITY_CHUNKS, "indexed")},
entity_edges AS (
    SELECT DISTINCT paper_id, 'AUTHORED' AS rel, unnest(authors) AS name FROM indexed
    UNION ALL
    SELECT paper_id, 'USES_METHOD', unnest(['Hashing', 'M' || substr(md5(prompt), 1, 2)]) FROM entity_prompts
    WHERE length(prompt) % 11 <> 0 AND length(prompt) % 7 <> 0 AND length(prompt) % 5 <> 0
    UNION ALL
    SELECT paper_id, 'EVALUATED_ON', unnest(CASE WHEN length(prompt) % 5 = 0 THEN ['A', 'Z']
        ELSE ['D' || substr(md5(prompt), 3, 2)] END) FROM entity_prompts
    WHERE length(prompt) % 11 <> 0 AND length(prompt) % 7 <> 0)"""


def summarize_all(spark, sf_dir):
    papers = paper_view(spark, sf_dir)
    chunks = paper_chunks(spark, sf_dir).join(papers.where("coalesce(pdf_url, '') <> ''").select("paper_id"), "paper_id", "left_semi")
    labelled = papers.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")
    done = labelled.select("paper_id", F.concat(F.lit("stored "), "paper_id").alias("tldr"), F.lit("then").alias("problem"))
    unknown = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("paper_id"))
    asked = papers.select("paper_id").unionByName(unknown)
    return summarize_papers(asked, papers, chunks, done, summary_stub, entity_stub)


@query("summarize_papers", f"WITH {SUMMARIZE_SQL} SELECT paper_id, status, message FROM summary_log")
def _summarize_papers(spark, sf_dir):
    return summarize_all(spark, sf_dir).log


@query("summary_status", f"WITH {SUMMARIZE_SQL} SELECT status, count(*) AS papers FROM summary_log GROUP BY status")
def _summary_status(spark, sf_dir):
    return summarize_all(spark, sf_dir).log.groupBy("status").agg(F.count("*").alias("papers"))


@query("summary_edges", f"WITH {SUMMARIZE_SQL} SELECT paper_id, rel, name FROM entity_edges")
def _summary_edges(spark, sf_dir):
    return summarize_all(spark, sf_dir).edges


@query(
    "summary_cards_all",
    f"""WITH {SUMMARIZE_SQL}, {AUTHOR_NAMES_SQL}
    SELECT paper_id, {", ".join(SUMMARY_FIELDS)}, {APA_SQL} AS citation_apa, {BIBTEX_SQL} AS citation_bibtex
    FROM parsed JOIN paper_view USING (paper_id) LEFT JOIN author_names USING (doc_id) WHERE ok
    UNION ALL SELECT paper_id, 'stored ' || paper_id, 'then', NULL, NULL, NULL, NULL, NULL FROM done""",
)
def _summary_cards_all(spark, sf_dir):
    return summarize_all(spark, sf_dir).all_cards


REVIEW_SIZE = 20


def review(spark, sf_dir):
    papers = paper_view(spark, sf_dir)
    stored = paper_chunks(spark, sf_dir).join(ingest_markers(spark, sf_dir).select("paper_id"), "paper_id", "left_semi")
    return literature_review(
        papers,
        paper_fetches(spark, sf_dir),
        document_lines(spark, sf_dir),
        ingest_markers(spark, sf_dir),
        stored.select("paper_id", "chunk_index", "text"),
        papers.join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id").select("paper_id"),
        summary_stub,
        entity_stub,
        max_papers=REVIEW_SIZE,
        year_from=1990,
        rejects=payload_rejects(spark, sf_dir),
    )


REVIEW_SQL = f"""{INGEST_SQL},
hits AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, source ORDER BY source_rank) AS nth FROM paper_view)
    WHERE nth <= {2 * REVIEW_SIZE}),
{first_wins_sql("topic", "hits")},
selected AS (
    SELECT * FROM (
        SELECT h.*, row_number() OVER (PARTITION BY topic ORDER BY coalesce(pdf_url, '') <> '' DESC,
                   published_date DESC NULLS LAST, source_pos, source_rank) AS selected_rank
        FROM hits h JOIN walk ON walk.doc_id = h.doc_id WHERE kept AND year(published_date) >= 1990)
    WHERE selected_rank <= {REVIEW_SIZE}),
stored_text AS (SELECT paper_id, abstract AS text FROM paper_view JOIN labels USING (doc_id)),
{sql_chunks("stored_text", "paper_id", CHUNK_SIZE, CHUNK_OVERLAP, "stored_chunks")},
review_chunks AS (SELECT * FROM stored_chunks UNION ALL SELECT * FROM chunks),
done AS (SELECT paper_id FROM paper_view JOIN labels USING (doc_id) WHERE quality = 0),
todo AS (
    SELECT s.* FROM selected s JOIN ingest_log i USING (paper_id)
    WHERE i.status IN ('success', 'already_cached') AND paper_id NOT IN (SELECT paper_id FROM done)),
{sql_prompts("summary_prompts", SUMMARY_INSTRUCTIONS, "Passages:", SUMMARY_CHUNKS, "todo", "review_chunks")},
{parsed_sql("summary_prompts")},
review AS (
    SELECT s.topic, s.selected_rank, s.paper_id, i.status AS ingest_status, i.message AS ingest_message,
           CASE WHEN i.status NOT IN ('success', 'already_cached') THEN NULL
                WHEN s.paper_id IN (SELECT paper_id FROM done) THEN 'already_cached'
                WHEN p.paper_id IS NULL THEN 'no_chunks_available'
                WHEN NOT ok THEN 'llm_failed' ELSE 'success' END AS summary_status,
           p.message AS summary_message
    FROM selected s JOIN ingest_log i ON i.paper_id = s.paper_id LEFT JOIN parsed p ON p.paper_id = s.paper_id)"""


@query(
    "literature_review",
    f"WITH RECURSIVE {REVIEW_SQL} SELECT topic, selected_rank, paper_id, ingest_status, summary_status FROM review",
)
def _literature_review(spark, sf_dir):
    result = review(spark, sf_dir)
    ingest = result.ingest.log.select("paper_id", F.col("status").alias("ingest_status"))
    summary = result.summary.log.select("paper_id", F.col("status").alias("summary_status"))
    chosen = result.selected.select("topic", F.col("selected_rank").cast("bigint").alias("selected_rank"), "paper_id")
    return chosen.join(ingest, "paper_id", "left").join(summary, "paper_id", "left")


@query(
    "review_report",
    f"""WITH RECURSIVE {REVIEW_SQL} SELECT topic, count(*) AS selected,
        count(*) FILTER (WHERE ingest_status IN ('success', 'already_cached')) AS ingested,
        count(*) FILTER (WHERE summary_status IN ('success', 'already_cached')) AS summarised
    FROM review GROUP BY topic""",
)
def _review_report(spark, sf_dir):
    return review(spark, sf_dir).report


@query(
    "review_errors",
    f"""WITH RECURSIVE {REVIEW_SQL}
    SELECT 'ingest' AS stage, paper_id, ingest_message AS message FROM review
    WHERE ingest_status IN ('download_failed', 'extraction_failed')
    UNION ALL SELECT 'summarize', paper_id, summary_message FROM review WHERE summary_status = 'llm_failed'
    UNION ALL SELECT 'search', NULL, source || ' item ' || CASE source WHEN 'pubmed'
        THEN (source_rank // {PER_RESPONSE}) * 4294967296 + source_rank % {PER_RESPONSE} ELSE source_rank END
        || ': ' || reject_reason FROM ({rejects_sql()}) WHERE reject_reason IS NOT NULL""",
)
def _review_errors(spark, sf_dir):
    return review(spark, sf_dir).errors
