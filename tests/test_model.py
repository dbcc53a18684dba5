import json
from datetime import date

from pyspark.sql import functions as F

from paperloom.operators.drafts import asked_ids, draft_members, related_work_draft
from paperloom.operators.model import call_model, embed_chunks, parse_entities, parse_responses
from paperloom.operators.views import summary_with_paper
from paperloom.plans.review import literature_review
from paperloom.plans.summarize import summarize_papers
from paperloom.schemas import SUMMARY_FIELDS

FULL = dict.fromkeys(SUMMARY_FIELDS, "text")
PAPER = """paper_id string, title string, authors array<string>, published_date date, doi string, url string"""


def responses(spark, *raw):
    rows = [(n, text if isinstance(text, (str, type(None))) else json.dumps(text)) for n, text in enumerate(raw)]
    return spark.createDataFrame(rows, "paper_id int, raw_response string").withColumn(
        "error", F.when(F.col("raw_response").isNull(), F.lit("down"))
    )


def test_required_fields(spark):
    raw = [
        FULL, "not valid json", None, {"tldr": "only"}, [1], {**FULL, "problem": ""}, {**FULL, "problem": 5},
        {**FULL, "tldr": "0"}, {**FULL, "key_results": None}, {**FULL, "limitations": []},
    ]
    parsed = parse_responses(responses(spark, *raw)).orderBy("paper_id").collect()
    not_object = "response is not a JSON object"
    assert [row.message for row in parsed] == [
        None, not_object, "down", "missing fields: problem, method_explained, key_results, limitations", not_object,
        "missing fields: problem", "missing fields: problem", None, "missing fields: key_results",
        "missing fields: limitations",
    ]
    assert [row.ok for row in parsed] == [row.message is None for row in parsed]


def test_entities_are_cleaned(spark):
    raw = [
        {"methods": ["ResNet", "  ResNet  ", "ResNet", 5, ""], "datasets": [" CIFAR-100 "]},
        {"methods": "ResNet"}, "broken", None,
    ]
    found = parse_entities(responses(spark, *raw)).orderBy("paper_id").collect()
    assert [(row.methods, row.datasets) for row in found] == [(["ResNet"], ["CIFAR-100"])] + [([], [])] * 3


def test_one_bad_prompt_fails_alone_and_answers_are_kept(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def model(prompts):
        import uuid
        from pathlib import Path

        (Path(str(log)) / uuid.uuid4().hex).write_text(str(len(prompts)))
        if any(prompt == "bad" for prompt in prompts):
            raise RuntimeError("refused")
        return [prompt.upper() for prompt in prompts]

    prompts = spark.createDataFrame([(n, "bad" if n == 3 else f"p{n}") for n in range(1000)], "n int, prompt string").coalesce(1)
    answers = call_model(prompts, model, ["n"], calls=1, batch_size=250)
    rows = {row.n: row for row in answers.collect()}
    sizes = [int(call.read_text()) for call in log.iterdir()]
    calls = len(sizes)
    assert max(sizes) == 250 and calls <= 4 + 2 * 8 and len(rows) == 1000
    assert rows[3].error == "refused" and rows[3].raw_response is None
    assert all(rows[n].raw_response == f"P{n}" for n in rows if n != 3)
    answers.count(), answers.where("error is null").count()
    assert len(list(log.iterdir())) == calls


def test_calls_are_spread_by_default(spark):
    """One partition of prompts is asked by as many tasks as there are cores."""

    def model(prompts):
        from pyspark import TaskContext

        return [str(TaskContext.get().partitionId()) for _ in prompts]

    prompts = spark.range(200).select("id", F.col("id").cast("string").alias("prompt")).coalesce(1)
    answers = call_model(prompts, model, ["id"]).collect()
    assert len({row.raw_response for row in answers}) == spark.sparkContext.defaultParallelism and len(answers) == 200


def test_embeddings(spark):
    chunks = spark.createDataFrame([("a b b",), ("",)], "text string")
    rows = embed_chunks(chunks).collect()
    assert abs(sum(value * value for value in rows[0].embedding) - 1) < 1e-6 and len(rows[1].embedding) == 64
    own = embed_chunks(chunks, lambda texts: [[float(len(text))] for text in texts]).collect()
    assert [row.embedding for row in own] == [[5.0], [0.0]]


def papers(spark, *ids):
    return spark.createDataFrame([(key, f"Title {key}", ["Ann Lee"], date(2020, 1, 1), None, None) for key in ids], PAPER)


def summarise(spark, asked, chunks, done, fn, known=("a", "b", "c")):
    return summarize_papers(
        spark.createDataFrame([(key,) for key in asked], "paper_id string"),
        papers(spark, *known),
        spark.createDataFrame([(key, 0, "text of " + key) for key in chunks] or [("", 0, "")], "paper_id string, chunk_index int, text string"),
        spark.createDataFrame([(key,) for key in done] or [("",)], "paper_id string"),
        fn,
        lambda prompts: [json.dumps({"methods": ["M"], "datasets": []}) for _ in prompts],
    )


def test_summary_ladder(spark):
    full = json.dumps(FULL)

    def model(prompts):
        return [json.dumps({"tldr": "x"}) if "Title b" in prompt else full for prompt in prompts]

    result = summarise(spark, ["a", "b", "c", "d", "e"], ["a", "b", "e"], ["e"], model, known=("a", "b", "c", "e"))
    log = {row.paper_id: (row.status, row.message) for row in result.log.collect()}
    assert log["a"] == ("success", None)
    assert log["b"] == ("llm_failed", "missing fields: problem, method_explained, key_results, limitations")
    assert log["c"] == ("no_chunks_available", None)
    assert log["d"] == ("not_ingested", None)
    assert log["e"] == ("already_cached", None)
    cards = result.cards.collect()
    assert [row.paper_id for row in cards] == ["a"] and cards[0].citation_apa == "Lee, A. (2020). Title a."
    assert {(row.paper_id, row.rel, row.name) for row in result.edges.collect()} == {
        ("a", "AUTHORED", "Ann Lee"), ("a", "USES_METHOD", "M"), ("e", "AUTHORED", "Ann Lee"), ("e", "USES_METHOD", "M"),
    }
    shown = summary_with_paper(result.cards, papers(spark, "a").withColumn("source", F.lit("arxiv"))).first()
    assert (shown.title, shown.source_label, shown.byline) == ("Title a", "ArXiv", "Ann Lee")


def test_failing_model_call(spark):
    def model(prompts):
        raise RuntimeError("down")

    assert summarise(spark, ["a"], ["a"], [], model).log.first().message == "down"


def test_drafts(spark):
    asked = asked_ids(
        spark.createDataFrame([(1, "b, gone,a,b"), (2, "gone")], "set_id int, paper_ids string")
    )
    summaries = spark.createDataFrame([("a", "ta", "@a"), ("b", "tb", "@b")], "paper_id string, tldr string, citation_bibtex string")
    members = draft_members(asked, summaries, papers(spark, "a", "b"))
    seen = {row.set_id: row for row in related_work_draft(members, lambda prompts: [json.dumps({"paragraph": p}) for p in prompts]).collect()}
    notes = ["(Lee, 2020) Title b: tb", "(Lee, 2020) Title a: ta", "(Lee, 2020) Title b: tb"]
    assert seen[1].paragraph.endswith("\n".join(notes))
    assert seen[1].bibtex_references == ["@b", "@a", "@b"] and seen[1].skipped_paper_ids == ["gone"]
    assert (seen[2].paragraph, seen[2].bibtex_references, seen[2].skipped_paper_ids) == ("", [], ["gone"])

    def broken(prompts):
        raise RuntimeError("down")

    failed = {row.set_id: row for row in related_work_draft(members, broken).collect()}
    assert failed[1].paragraph == "" and failed[1].bibtex_references == ["@b", "@a", "@b"]


def test_review_stages(spark):
    hits = spark.createDataFrame(
        [
            ("t", "arxiv", 0, n, f"x/{n}", f"Title {n}", ["Ann Lee"], date(2000 + n, 1, 1), None, None, "pdf" if n else "")
            for n in range(3)
        ],
        """topic string, source string, source_pos int, source_rank bigint, external_id string, title string,
        authors array<string>, published_date date, doi string, url string, pdf_url string""",
    )
    ids = [f"arxiv_x_{n}" for n in range(3)]
    fetches = spark.createDataFrame([(ids[1], True, None), (ids[2], False, None)], "paper_id string, fetched boolean, extract_error string")
    pages = spark.createDataFrame([(ids[1], 0, "long text " * 20)], "paper_id string, page_no int, text string")
    result = literature_review(
        hits, fetches, pages,
        spark.createDataFrame([], "paper_id string, chunk_count bigint, page_count bigint"),
        spark.createDataFrame([], "paper_id string, chunk_index int, text string"),
        spark.createDataFrame([], "paper_id string"),
        lambda prompts: [json.dumps(FULL) for _ in prompts],
        lambda prompts: ["{}" for _ in prompts],
        max_papers=2,
    )
    assert tuple(result.report.first()) == ("t", 2, 1, 1)
    assert [tuple(row)[:2] for row in result.errors.collect()] == [("ingest", ids[2])]
    assert [row.paper_id for row in result.summary.cards.collect()] == [ids[1]]
