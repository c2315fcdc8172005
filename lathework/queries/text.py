"""Text identities, repetition, lexicon matches and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import digest, exact_normalize, jaccard, matches_of, normalize, opening, phrases, spoken_tokens, word_tokens
from . import norm_sql, query, read

#: Text that composition can't change and whose folding is plain lower case but for ß.
PLAIN = r"^[\x00-\xb4\xb6-\x{12f}\x{132}-\x{148}\x{14a}-\x{17e}\x{2000}-\x{206f}\x{20a0}-\x{20bf}]*$"

_EXACT = r"trim(regexp_replace(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ς', 'σ'), '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g'))"


@query(f"select doc_id, sha256(text) as original_sha256, sha256({_EXACT}) as normalized_sha256 from documents where text is not null")
def text_identity(spark, d):
    """Digests of every text as it is and in its normal form; only texts that need it leave the JVM."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", "text")
    plain = F.col("text").rlike(PLAIN)
    each = lambda df, form: df.select("doc_id", digest(F.col("text")).alias("original_sha256"), digest(form).alias("normalized_sha256"))
    return each(docs.where(plain), normalize(F.col("text"))).unionByName(each(docs.where(~plain), exact_normalize("text")))


@query(f"with n as (select doc_id, {norm_sql('text')} as t from documents where text is not null) select sha256(t) as normalized_sha256, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from n group by t having count(*) > 1")
def duplicate_groups(spark, d):
    """Groups of documents with the same normal form."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", digest(normalize(F.col("text"))).alias("normalized_sha256"))
    return docs.groupBy("normalized_sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


_SPOKEN = f"regexp_extract_all({norm_sql('x')}, '[a-z0-9]+(?:''[a-z0-9]+)?')"


@query(
    f"""with t as (select example_id, {_SPOKEN} as w from (select distinct example_id, m as x from (select example_id, unnest(assistant_response.method) as m from candidates))),
    s as (select example_id, array_to_string(w[i : i + 7], ' ') as phrase from t, unnest(generate_series(1, len(w) - 7)) as g(i) where len(w) >= 8)
    select phrase, count(distinct example_id) as n from s group by phrase having count(distinct example_id) >= 2 order by n desc, phrase limit 30"""
)
def repeated_phrases(spark, d):
    """The 30 eight-word phrases that most examples' method steps share: a report."""
    steps = read(spark, d, "candidates").select("example_id", F.explode("assistant_response.method").alias("x")).distinct()
    return phrases(steps, ["example_id"], "x", 8).groupBy("phrase").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "phrase").limit(30)


@query(
    f"""with t as (select distinct example_id, {_SPOKEN} as w from (select example_id, user_prompt as x from candidates where user_prompt is not null))
    select array_to_string(w[1:4], ' ') as opening, count(distinct example_id) as n from t where len(w) >= 4 group by 1 having count(distinct example_id) >= 3"""
)
def repeated_openings(spark, d):
    """Four-word openings that at least three prompts share."""
    prompts = read(spark, d, "candidates").where("user_prompt is not null").select("example_id", spoken_tokens(F.col("user_prompt")).alias("w")).select("example_id", opening(F.col("w"), 4).alias("opening")).where("opening is not null").distinct()
    return prompts.groupBy("opening").agg(F.count("*").alias("n")).where("n >= 3")


@query(f"select {norm_sql('assistant_response.title')} as title, count(distinct example_id) as n from candidates where assistant_response.title is not null group by 1 having count(distinct example_id) >= 2")
def duplicate_titles(spark, d):
    """Titles that at least two examples share."""
    titles = read(spark, d, "candidates").where("assistant_response.title is not null").select("example_id", normalize(F.col("assistant_response.title")).alias("title"))
    return titles.groupBy("title").agg(F.countDistinct("example_id").alias("n")).where("n >= 2")


@query(
    """with s as (select distinct example_id, i.amount as amount, i.unit as unit from (select example_id, unnest(assistant_response.ingredients) as i from candidates))
    select unit, count(*) as n, round(avg(amount), 6) as mean_amount, min(amount) as least, max(amount) as most from s group by unit"""
)
def measure_profile(spark, d):
    """Distinct measures of the examples by unit."""
    rows = read(spark, d, "candidates").select("example_id", F.explode("assistant_response.ingredients").alias("i")).select("example_id", "i.amount", "i.unit").distinct()
    return rows.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg("amount"), 6).alias("mean_amount"), F.min("amount").alias("least"), F.max("amount").alias("most"))


# A lexicon of expressions to look for.
LEXICON = [r"\bdata migration\b", r"\btax return\b", r"\blanguage exams?\b", r"\bboiler\w*\b", r"\bpottery\b", r"\bmuseum (?:visit|guide)s?\b"]


@query(
    f"""with t as (select doc_id, list_sort(list_distinct(flatten([{', '.join(f"regexp_extract_all({norm_sql('text')}, '{p}')" for p in LEXICON)}]))) as m from documents where text is not null)
    select doc_id, array_to_string(m, ',') as terms, len(m) as n from t where len(m) > 0"""
)
def withheld_terms(spark, d):
    """Documents with expressions of the lexicon, and which."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", normalize(F.col("text")).alias("t")).select("doc_id", matches_of(F.col("t"), LEXICON).alias("m"))
    return docs.where(F.size("m") > 0).select("doc_id", F.array_join("m", ",").alias("terms"), F.size("m").cast("long").alias("n"))


def response_view(r: Column) -> Column:
    """A response as lines: title, measures joined by semicolons, steps, garnish; what is null is left out."""
    amount = lambda a: F.regexp_replace(a.cast("string"), r"\.0$", "")
    parts = F.transform(r["ingredients"], lambda i: F.concat_ws(" ", amount(i["amount"]), i["unit"], i["name"]))
    return F.concat_ws("\n", r["title"], F.array_join(parts, "; "), F.array_join(r["method"], "\n"), r["garnish"])


@query(
    r"""with r as (select distinct example_id, concat_ws(chr(10), assistant_response.title, array_to_string(list_transform(assistant_response.ingredients, lambda i: concat_ws(' ', regexp_replace(cast(i.amount as varchar), '\.0$', ''), i.unit, i.name)), '; '), array_to_string(assistant_response.method, chr(10)), assistant_response.garnish) as v from candidates)
    select example_id, sha256(v) as view_sha256, len(v) as characters from r"""
)
def response_text_view(spark, d):
    """Digest and length of each response's text view."""
    view = response_view(F.col("assistant_response"))
    return read(spark, d, "candidates").select("example_id", view.alias("v")).distinct().select("example_id", digest(F.col("v")).alias("view_sha256"), F.length("v").cast("long").alias("characters"))


@query(r"select doc_id, len(regexp_extract_all(text, '\S+')) as words, len(regexp_extract_all(text, '\S+')) > 256 as truncated from documents where text is not null")
def truncation_diagnostics(spark, d):
    """Documents longer than 256 words between blanks."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).cast("long")
    return read(spark, d, "documents").where("text is not null").select("doc_id", words.alias("words"), (words > 256).alias("truncated"))


@query(
    """with k as (select distinct case_id, existing_prompt as a, candidate_prompt as b from contamination_calibration),
    t as (select case_id, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')) as x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')) as y from k where a is not null and b is not null)
    select case_id, round(case when len(list_distinct(list_concat(x, y))) = 0 then 0.0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end, 6) as score from t"""
)
def case_token_jaccard(spark, d):
    """Token overlap of the two prompts of every calibration case."""
    cases = read(spark, d, "contamination_calibration").select("case_id", "existing_prompt", "candidate_prompt").distinct().where("existing_prompt is not null and candidate_prompt is not null")
    return cases.select("case_id", F.round(jaccard(word_tokens(F.col("existing_prompt")), word_tokens(F.col("candidate_prompt"))), 6).alias("score"))


@query(
    r"""with p as (select distinct example_id, user_prompt as p from candidates where user_prompt is not null)
    select example_id, p = trim(p, E' \t\n\r') as trimmed, len(p) <= 500 as short_enough, strlen(p) <= 4096 as small_enough, regexp_full_match(example_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') as good_id from p"""
)
def request_contract(spark, d):
    """Whether each prompt could be a request: trimmed, at most 500 characters and 4096 bytes, a proper identifier."""
    p = F.col("user_prompt")
    rows = read(spark, d, "candidates").where("user_prompt is not null").select("example_id", "user_prompt").distinct()
    return rows.select("example_id", (p == F.regexp_replace(p, r"^[ \t\n\r]+|[ \t\n\r]+$", "")).alias("trimmed"), (F.length(p) <= 500).alias("short_enough"), (F.octet_length(p) <= 4096).alias("small_enough"), F.col("example_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$").alias("good_id"))
