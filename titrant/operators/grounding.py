"""Checks of written answers and headlines against the report they describe.

Joins by report or answer carry the merge hint: file sizes make their sides look
small enough to broadcast, and a broadcast would pass them through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from titrant.fixed import lexicons as lx, safety as fs
from titrant.functions import text as tx
from titrant.functions.grams import contained_pairs

ABS_TOLERANCE, REL_TOLERANCE = 0.5, 0.05
_LOG_STEP = 0.05  # narrower than the log width of the relative tolerance


# ---- text predicates -----------------------------------------------------

def _any_pattern(c: Column, patterns) -> Column:
    return c.rlike("(?iU)(?:" + "|".join(patterns) + ")")


def denied_wording(c: Column, patterns=tuple(lx.ANSWER_DENIED)) -> Column:
    return F.coalesce(_any_pattern(c, patterns), F.lit(False))


def drug_or_dose(c: Column, drugs=tuple(fs.DRUG_NAMES), dose: str = lx.ANSWER_DOSE) -> Column:
    """A drug name as a whole run of letters, or a dose."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z]+"), F.lit(0))
    return F.coalesce(F.arrays_overlap(words, F.array(*[F.lit(d) for d in drugs])) | c.rlike("(?U)" + dose), F.lit(False))


def comparative_ratio(c: Column) -> Column:
    return F.coalesce(c.rlike("(?U)" + lx.COMPARATIVE_RATIO), F.lit(False))


def acute_symptom(question: Column, lang: Column, phrases: dict = fs.ACUTE_SYMPTOMS) -> Column:
    """A phrase of the question's language between non-word characters; unknown
    languages read as English."""
    q = F.lower(F.coalesce(question, F.lit("")))
    pattern = {k: r"(?U)(?:^|\W)(?:" + "|".join(tx.escape(p.lower()) for p in v) + r")(?:\W|$)" for k, v in phrases.items()}
    other = reduce(lambda e, k: e.when(lang == k, q.rlike(pattern[k])), [k for k in pattern if k != "en"], F)
    return F.coalesce(other.otherwise(q.rlike(pattern["en"])), F.lit(False))


def doctor_phrase(lang: Column) -> Column:
    m = tx.literal_map(fs.DOCTOR_PHRASES.items())
    return F.coalesce(F.element_at(m, lang), F.lit(fs.DOCTOR_PHRASES["en"]))


def validator_failure(reason: Column) -> Column:
    return F.split_part(F.coalesce(reason, F.lit("")), F.lit(":"), F.lit(1)).isin(*lx.VALIDATOR_REASONS)


def follow_ups(lang: Column) -> Column:
    expr = F
    for k, v in lx.FOLLOW_UPS.items():
        if k != "en":
            expr = expr.when(lang == k, F.array(*[F.lit(x) for x in v]))
    return expr.otherwise(F.array(*[F.lit(x) for x in lx.FOLLOW_UPS["en"]]))


def refusal_text(lang: Column, reason: Column) -> Column:
    def pick(texts):
        return F.coalesce(F.element_at(tx.literal_map(texts.items()), lang), F.lit(texts["en"]))
    return F.when(validator_failure(reason), pick(lx.VALIDATOR_FAIL)).otherwise(pick(lx.OUT_OF_SCOPE))


def refusal(lang: Column, reason: Column) -> Column:
    """Refusal envelope in the language, worded by reason class."""
    return F.struct(
        refusal_text(lang, reason).alias("answer"), follow_ups(lang).alias("follow_ups"),
        F.lit(False).alias("doctor_routing"), F.lit(True).alias("refused"), reason.alias("refusal_reason"))


# ---- headlines -----------------------------------------------------------

def headline_problem(text: Column, status: Column, findings: Column) -> Column:
    """First reason to reject a headline, null when it passes.  `findings` is
    the array of leading test names."""
    t = tx.strip(text)
    low = F.lower(t)
    words = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    tokens = F.regexp_extract_all(low, F.lit("[a-zA-Z]+"), F.lit(0))
    allowed = F.transform(findings, lambda n: tx.fold_key(n))
    folded = tx.fold_key(t)

    def first_pattern(patterns, c, prefix):
        return F.coalesce(*[F.when(c.rlike("(?iU)" + p), F.lit(prefix + p)) for p in patterns])

    drug = F.try_element_at(F.filter(tokens, lambda w: w.isin(*lx.HEADLINE_DRUGS)), F.lit(1))
    missing = reduce(lambda e, kv: e.when(status == kv[0], ~low.rlike(r"(?U)\b(?:" + "|".join(kv[1]) + r")\b")),
                     [(k, v) for k, v in lx.STATUS_WORDS.items() if v], F).otherwise(False)
    off_list = F.try_element_at(F.filter(
        F.array(*[F.lit(a) for a in lx.HEADLINE_ANALYTES]),
        lambda a: F.contains(folded, a) & ~F.exists(allowed, lambda n: F.contains(n, a))), F.lit(1))
    return F.coalesce(
        F.when(F.coalesce(t, F.lit("")) == "", "empty"),
        F.when(F.contains(t, F.lit("\n")), "multiline"),
        F.when(~words.between(6, 25), F.concat(F.lit("word_count="), words.cast("string"))),
        first_pattern(lx.HEADLINE_DENIED, low, "denied_verb:"),
        first_pattern(lx.HEADLINE_ALARMIST, t, "alarmist:"),
        F.concat(F.lit("drug:"), drug),
        F.when(t.rlike("(?U)" + lx.HEADLINE_DOSE), "dose_pattern"),
        F.when(missing, F.concat(F.lit("missing_status_word:"), status)),
        F.concat(F.lit("off_list_analyte:"), off_list))


# ---- numbers -------------------------------------------------------------

def without_timeframes(c: Column) -> Column:
    for p in lx.TIMEFRAME_PATTERNS:
        c = F.regexp_replace(c, "(?U)" + p, "")
    return c


def numbers_in(c: Column) -> Column:
    """Numbers of a prepared text: not glued to letters; a hyphen after a digit
    is no minus; short list bullets are skipped."""
    number = r"(?<![A-Za-z])(?:(?<!\d)-)?\d+(?:\.\d+)?(?![A-Za-z])"
    # the bullet alternative consumes `1. ` / `2) ` so that it is not extracted
    bullet = r"(?<![^ \n\t])(?:-\d|\d{1,2})(?=[.)] )"
    found = F.regexp_extract_all(c, F.lit(f"(?:{bullet})|({number})"), F.lit(1))
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("double"))


def strip_report_names(answers: DataFrame, names: DataFrame, text: str = "answer") -> DataFrame:
    """Replace the report's digit-bearing test names in each answer by a word.

    `names` holds report_id, name and the first position of the name on the
    report.  Only names that occur in the answer are gathered for it, so what
    is gathered is bounded by the answer's own length.
    """
    short = (names.filter(F.col("name").rlike(r"\d")).withColumn("_short", F.lower("name"))
             .select("report_id", "_short", "position"))
    long = answers.select("report_id", "answer_id", F.lower(text).alias("_long"))
    pairs = contained_pairs(short, long, ["report_id"], "_short", "_long")
    inside = pairs.groupBy("report_id", "answer_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "_short"))).alias("_names"))
    quoted = lambda n: F.concat(F.lit(r"(?iu)\Q"), n, F.lit(r"\E"))
    return answers.join(inside.hint("merge"), ["report_id", "answer_id"], "left").withColumn("_clean", F.when(
        F.col("_names").isNull(), F.col(text)).otherwise(F.aggregate(
            "_names", F.col(text), lambda acc, n: F.regexp_replace(acc, quoted(n["_short"]), F.lit("TESTNAME"))))).drop("_names")


def answer_numbers(answers: DataFrame, names: DataFrame, text: str = "answer") -> DataFrame:
    """Add `numbers`: the standalone numbers an answer states."""
    prepared = strip_report_names(answers.withColumn("_t", without_timeframes(F.coalesce(F.col(text), F.lit("")))), names, "_t")
    coded = F.regexp_replace("_clean", "(?U)" + lx.DIGIT_PAIR, "CODE")
    return prepared.withColumn("numbers", numbers_in(coded)).drop("_t", "_clean")


def report_numbers(compact: DataFrame) -> DataFrame:
    """Distinct numbers of a report: values and both bounds."""
    return compact.select("report_id", F.explode(F.array_compact(F.array("value_num", "ref_low", "ref_high"))).alias("number")).distinct()


def close_to(a: Column, c: Column) -> Column:
    """Tolerant equality of a stated and a reported number.  Equality after
    rounding to 0, 1 or 2 digits implies a difference of at most 0.5."""
    return (F.abs(a - c) <= ABS_TOLERANCE) | ((c != 0) & (F.abs(a - c) / F.abs(c) <= REL_TOLERANCE))


def ungrounded_numbers(stated: DataFrame, reported: DataFrame) -> DataFrame:
    """Stated numbers (report_id, answer_id, number) with no close number on the
    report.

    Both tolerances are intervals around the stated number.  Reported numbers
    are cut into unit cells, and by sign into log cells, keeping the smallest
    and largest number of each.  An interval wider than a cell meets a number
    of a cell exactly when it covers the cell's smallest or largest number, so
    each stated number probes a handful of cells instead of the whole report.
    """
    def cells(kind, cell):
        return reported.select("report_id", "number", F.lit(kind).alias("kind"), cell.cast("long").alias("cell"))

    n = F.col("number")
    log_cell = F.floor(F.log(F.abs(n)) / _LOG_STEP)
    by_cell = (cells("unit", F.floor(n))
               .unionByName(cells("pos", log_cell).filter("number > 0"))
               .unionByName(cells("neg", log_cell).filter("number < 0"))
               .groupBy("report_id", "kind", "cell").agg(F.min("number").alias("lo"), F.max("number").alias("hi")))

    # the log interval that |c| must fall in: |a| / 1.05 .. |a| / 0.95
    first = F.floor(F.log(F.abs(n) / (1 + REL_TOLERANCE)) / _LOG_STEP) - 1
    last = F.floor(F.log(F.abs(n) / (1 - REL_TOLERANCE)) / _LOG_STEP) + 1
    unit_probe = F.transform(F.sequence(F.floor(n - ABS_TOLERANCE), F.floor(n + ABS_TOLERANCE)),
                             lambda x: F.struct(F.lit("unit").alias("kind"), x.cast("long").alias("cell")))
    log_probe = F.when(n != 0, F.transform(F.sequence(first, last), lambda x: F.struct(
        F.when(n > 0, "pos").otherwise("neg").alias("kind"), x.cast("long").alias("cell"))))
    once = stated.select("report_id", "number").distinct()
    probes = once.withColumn("p", F.explode(F.concat(unit_probe, F.coalesce(log_probe, F.array().cast("array<struct<kind:string,cell:bigint>>")))))
    met = probes.select("report_id", "number", "p.*").join(by_cell.hint("merge"), ["report_id", "kind", "cell"]).filter(
        close_to(n, F.col("lo")) | close_to(n, F.col("hi"))).select("report_id", "number").distinct()
    return stated.join(met.hint("merge"), ["report_id", "number"], "left_anti")


# ---- citations -----------------------------------------------------------

def unresolved_citations(cited: DataFrame, names: DataFrame) -> DataFrame:
    """Citations (report_id, answer_id, cite_pos, cited_name) whose folded name
    neither equals, contains nor is contained in a test name of the report."""
    key = ["report_id", "folded"]
    c = cited.withColumn("folded", tx.fold_key(F.col("cited_name")))
    known = names.select("report_id", tx.fold_key(F.col("name")).alias("folded")).filter("folded <> ''").distinct()
    # exact names settle most citations and skip the containment tests
    open_ = c.join(known.hint("merge"), key, "left_anti").select(*key).filter("folded <> ''").distinct()
    n = known.withColumnRenamed("folded", "known")
    inside = contained_pairs(open_, n, ["report_id"], "folded", "known").select(*key)
    around = contained_pairs(n, open_, ["report_id"], "known", "folded").select(*key)
    resolved = known.unionByName(inside).unionByName(around).distinct()
    return c.join(resolved.hint("merge"), key, "left_anti")


# ---- answers -------------------------------------------------------------

def validate_answers(answers: DataFrame, compact: DataFrame) -> DataFrame:
    """Run the guardrails on answers (report_id, answer_id, question, language,
    parsed: struct or null) against compact report rows.

    The first failing check names the refusal; passing answers get the doctor
    routing of their report or question.
    """
    key = ["report_id", "answer_id"]
    p = F.col("parsed")
    a = answers.withColumns({"answer": p.answer, "citations": F.coalesce(p.citations, F.array().cast("array<struct<test_name:string,value:string,unit:string,health_topic:string>>"))})
    a = a.withColumn("well_formed", F.coalesce(tx.strip(F.col("answer")) != "", F.lit(False)))
    good = a.filter("well_formed")
    names = compact.groupBy("report_id", "name").agg(F.min(F.struct("page_num", "row_idx")).alias("position"))

    cites = good.select(*key, F.posexplode("citations").alias("cite_pos", "c")).select(*key, "cite_pos", F.col("c.test_name").alias("cited_name"))
    bad_cites = unresolved_citations(cites, names).groupBy(*key).agg(
        F.min_by(F.when(F.col("folded") == "", "citation_empty").otherwise(F.concat(F.lit("invalid_cite:"), F.coalesce("cited_name", F.lit("None")))), "cite_pos").alias("cite_reason"))

    numbered = answer_numbers(good.select(*key, "answer", "citations"), names)
    own = F.array_compact(F.transform("citations", lambda c: tx.plain_number(c.value)))
    stated = numbered.withColumn("own", own).select(*key, "own", F.posexplode("numbers").alias("num_pos", "number")).filter(
        ~F.exists("own", lambda c: close_to(F.col("number"), c)))
    invented = ungrounded_numbers(stated.select(*key, "num_pos", "number"), report_numbers(compact)).groupBy(*key).agg(
        F.min_by("number", "num_pos").alias("invented"))

    reports = compact.groupBy("report_id").agg(F.bool_or(
        F.col("is_panic") | F.col("severity").isin("moderate", "critical")).alias("report_serious"))
    j = a.join(bad_cites.hint("merge"), key, "left").join(invented.hint("merge"), key, "left").join(reports.hint("merge"), "report_id", "left")
    reason = F.coalesce(
        F.when(~F.col("well_formed"), "schema_invalid"), F.col("cite_reason"),
        F.when(comparative_ratio(F.col("answer")), "comparative_ratio"),
        F.concat(F.lit("invented_number:"), tx.number_text("invented")),
        F.when(denied_wording(F.col("answer")), "denied_verb"),
        F.when(drug_or_dose(F.col("answer")), "drug_or_dose"))
    routed = F.coalesce("report_serious", F.lit(False)) | acute_symptom(F.col("question"), F.col("language"))
    return finish_answers(j.withColumns({"reason": reason, "routed": routed}))


def with_doctor_phrase(answer: Column, lang: Column) -> Column:
    phrase = doctor_phrase(lang)
    return F.when(F.contains(answer, phrase), answer).otherwise(F.concat(F.rtrim(answer), F.lit(" "), phrase))


def finish_answers(j: DataFrame) -> DataFrame:
    """Passing answers with routing and defaults, failing ones as refusals."""
    ok = F.col("reason").isNull()
    p, lang = F.col("parsed"), F.col("language")
    return j.select(
        "report_id", "answer_id",
        F.when(ok, F.when(F.col("routed"), with_doctor_phrase(F.col("answer"), lang)).otherwise(F.col("answer")))
        .otherwise(refusal_text(lang, F.col("reason"))).alias("answer"),
        F.when(ok, F.col("citations")).otherwise(F.slice("citations", 1, 0)).alias("citations"),
        F.when(ok & (F.size(p.follow_ups) > 0), p.follow_ups).otherwise(follow_ups(lang)).alias("follow_ups"),
        F.when(ok, F.col("routed") | F.coalesce(p.doctor_routing, F.lit(False))).otherwise(False).alias("doctor_routing"),
        F.when(ok, F.coalesce(p.refused, F.lit(False))).otherwise(True).alias("refused"),
        F.when(ok, p.refusal_reason).otherwise(F.col("reason")).alias("refusal_reason"))


def coerce_answers(answers: DataFrame) -> DataFrame:
    """Final shape: default text, clipped citation names, at most five clipped
    follow-ups."""
    text = tx.strip(F.coalesce("answer", F.lit("")))
    return answers.withColumns({
        "answer": F.when(text != "", text).otherwise("Sorry, I couldn't generate an answer."),
        "citations": F.transform("citations", lambda c: c.withField("test_name", F.substring(F.coalesce(c.test_name, F.lit("")), 1, 200))),
        "follow_ups": F.slice(F.transform("follow_ups", lambda x: F.substring(x, 1, 200)), 1, 5)})


CITATIONS = "array<struct<test_name:string,value:string,unit:string,health_topic:string>>"


def deterministic_answers(questions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Answer from the report summary alone, for questions nothing answered.
    `summaries` holds report_id, headline, top_findings, report_serious."""
    j = questions.join(summaries.hint("merge"), "report_id", "left")
    leading = F.slice("top_findings", 1, 3)
    names = F.transform(leading, lambda f: f.test_name)
    citations = F.transform(leading, lambda f: F.struct(
        f.test_name.alias("test_name"), F.coalesce(f.value_num.cast("string"), f.value_text).alias("value"),
        f.finding_unit.alias("unit"), f.finding_topic.alias("health_topic")))
    base = F.coalesce(F.nullif(F.col("headline"), F.lit("")), F.lit("I can summarize what's in this report."))
    english = F.when(F.size(names) > 0, F.concat(base, F.lit(" Items to discuss: "), F.array_join(names, ", "), F.lit("."))).otherwise(base)
    lang = F.col("language")
    return j.select(
        "report_id", "answer_id",
        F.when(lang == "en", english).otherwise(refusal_text(lang, F.lit("llm_unavailable"))).alias("answer"),
        F.coalesce(names, F.array().cast("array<string>")).alias("cited"), F.coalesce(citations, F.array().cast(CITATIONS)).alias("citations"), follow_ups(lang).alias("follow_ups"),
        (F.coalesce("report_serious", F.lit(False)) | acute_symptom(F.col("question"), lang)).alias("doctor_routing"),
        F.lit(False).alias("refused"))


# ---- chat history --------------------------------------------------------

def usable_turn() -> Column:
    text = F.col("text")
    return (F.col("role").isin("user", "assistant") & (tx.strip(F.coalesce(text, F.lit(""))) != "")
            & ~F.substring(text, 1, 2000).rlike(lx.ROLE_PREFIX))


def sanitise_history(turns: DataFrame, last: int = 6, clip: int = 2000) -> DataFrame:
    """The last turns of each conversation that are usable and alternate roles.

    The cut to the last turns happens before the shuffle; what remains per
    conversation is at most that many rows.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last).filter(usable_turn())
    along = Window.partitionBy("conv_id").orderBy("turn")
    prev = F.lag("role").over(along)
    return (recent.withColumn("_prev", prev).filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("role")))
            .select("conv_id", "turn", "role", F.substring("text", 1, clip).alias("text")))


def clean_questions(turns: DataFrame, clip: int = 500) -> DataFrame:
    return turns.withColumn("question", F.substring(tx.redact_question(tx.strip(F.col("text"))), 1, clip))
