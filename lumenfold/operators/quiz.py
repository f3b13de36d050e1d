"""Quizzes from captured states: questions, options, answers, quality codes and renderings. Native.

A state is (capture_id, step, phase, root, options): phase is pre, hint or reveal,
options an array of struct(i, raw, attrs). The folds that depend on order are
aggregate() over arrays, so that a question is one row throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions.tex import let, quiz_marks, without_forms

OPTION_MARK = "@@OPT@@"
_CAPTIONS = "(?i)^[ \\t]*(Hint|تلميح|Next|التالي|Previous|السابق)[ \\t]*$"

# Fixed value: the characters of a formula, which needs no translation.
FORMULA = "^[0-9" + T.SPACE + r".,%+\-–×/^()<>=a-zA-Z²³¹⁰-⁹µ°]+$"


def added_lines(before: Column, after: Column) -> Column:
    """The lines of after that are not the next expected line of before, in order.

    A line of before that is missing in after blocks all later matches.
    """
    start = F.struct(F.lit(0).alias("j"), F.array().cast("array<string>").alias("out"))

    def added(before: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            expected = F.coalesce(F.get(before, acc["j"]) == x, F.lit(False))
            return let(expected, lambda e: F.struct((acc["j"] + e.cast("int")).alias("j"), F.when(e, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out")))

        return F.aggregate(after, start, step, lambda acc: acc["out"])

    return let(before, added)


def bilingual(lines: Column) -> Column:
    """struct(en, ar) of lines: each goes to its script; a short Latin line inside an Arabic sentence stays with it.

    Such a line follows an Arabic one that ends no sentence, and is followed by an
    Arabic one or ends the text. A line that was taken over counts as Arabic.
    """
    arabic = lambda x: F.coalesce(x.rlike(f"[{T.ARABIC}]"), F.lit(False))
    start = F.struct(F.lit(False).alias("ar"), F.array().cast("array<boolean>").alias("kinds"))

    def split(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

        def step(acc: Column, y: Column) -> Column:
            x, i = y["x"], y["i"]
            short = (F.length(x) <= 40) & ~(T.ends_sentence(x) & (F.length(x) > 25))
            before = (i > 0) & acc["ar"] & ~F.coalesce(T.ends_sentence(F.get(lines, i - 1)), F.lit(False))
            after = (i + 1 >= F.size(lines)) | arabic(F.get(lines, i + 1))
            return let(arabic(x) | (short & before & after), lambda kind: F.struct(kind.alias("ar"), F.concat(acc["kinds"], F.array(kind)).alias("kinds")))

        def sides(zipped: Column) -> Column:
            side = lambda want: T.join_parts(F.transform(F.filter(zipped, lambda z: z["k"] == want), lambda z: z["x"]))
            return F.struct(side(False).alias("en"), side(True).alias("ar"))

        kinds = F.aggregate(numbered, start, step, lambda acc: acc["kinds"])
        return let(F.arrays_zip(lines.alias("x"), kinds.alias("k")), sides)

    return let(lines, split)


def root_lines(root: Column) -> Column:
    """The lines of a state's text, counters in one line, spacing fixed, without empty ones."""
    lines = F.transform(T.split_lines(T.joined_counters(quiz_marks(T.plain_spaces(T.without_invisible(F.coalesce(root, F.lit(""))), thin=False)))), lambda x: T.fix_spacing(x))
    return F.filter(lines, lambda x: x != "")


def option_lines(raw: Column) -> Column:
    return T.content_lines(T.split_lines(T.plain_spaces(T.without_invisible(F.coalesce(raw, F.lit(""))), thin=False)))


def stem_of(lines: Column) -> Column:
    """The lines between the first counter and the first option mark, without icons."""
    mark = F.array_position(lines, OPTION_MARK).cast("int")
    head = F.when(mark > 0, F.slice(lines, F.lit(1), mark - 1)).otherwise(lines)
    places = F.filter(F.transform(head, lambda x, i: F.when(T.counter(x)["number"].isNotNull(), i + 1)), lambda i: i.isNotNull())
    first = F.get(places, F.lit(0))
    body = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.slice(head, first + 1, F.size(head)))
    return F.filter(body, lambda x: ~T.is_icon_name(x) & ~T.is_icon_word(x))


def counter_of(lines: Column) -> Column:
    """The counter of a state, from the first line that is one before the first option mark."""
    mark = F.array_position(lines, OPTION_MARK).cast("int")
    head = F.when(mark > 0, F.slice(lines, F.lit(1), mark - 1)).otherwise(lines)
    return F.get(F.filter(F.transform(head, T.counter), lambda c: c["number"].isNotNull()), F.lit(0))


def parsed_states(states: DataFrame) -> DataFrame:
    """States with their lines, and options as struct(i, lines, attrs)."""
    raw = states.withColumn("root", without_forms(F.col("root"))).withColumn("lines", root_lines(F.col("root")))
    one = raw.select("capture_id", "step", "phase", "lines", F.posexplode_outer("options").alias("k", "o"))
    one = one.withColumn("raw", without_forms(F.coalesce(F.col("o.raw"), F.lit("")))).withColumn("text", quiz_marks(F.col("raw")))
    option = F.struct(F.col("o.i").alias("i"), option_lines(F.col("text")).alias("lines"), F.coalesce(F.col("o.attrs"), F.lit("")).alias("attrs"))
    options = F.array_sort(F.collect_list(F.when(F.col("o").isNotNull(), F.struct(F.col("k"), option.alias("o")))))
    return one.groupBy("capture_id", "step", "phase").agg(F.first("lines").alias("lines"), F.transform(options, lambda x: x["o"]).alias("options"))


def questions(states: DataFrame, reveal: bool = True, hints: bool = True) -> DataFrame:
    """One row for each step: number, total, stem, hint, options, correct, and raw lines where there are no options.

    The phases of a step meet by one aggregation on (capture_id, step). Of options
    that only the revealed state has, nothing is taken. Null roots and options are
    empty; a step without a pre state has no number; of a phase that repeats, one of
    its rows counts; an empty table gives an empty result; other columns are ignored.
    """
    parsed = parsed_states(states)
    phase = lambda name, c: F.max_by(F.when(F.col("phase") == name, F.col(c)), F.col("phase") == name)
    names = ("pre", "hint", "reveal")
    rows = parsed.groupBy("capture_id", "step").agg(*[phase(n, c).alias(f"{n}_{c}") for n in names for c in ("lines", "options")])
    empty_lines = F.array().cast("array<string>")
    shown = F.col("hint_options") if hints else F.lit(None)
    base = rows.withColumn("counter", counter_of(F.col("pre_lines"))).withColumn("shown", F.coalesce(shown, F.col("pre_options")))
    hint_new = F.filter(added_lines(F.col("pre_lines"), F.coalesce("hint_lines", "pre_lines")), lambda x: (x != OPTION_MARK) & ~x.rlike(_CAPTIONS))

    def option(o: Column, k: Column) -> Column:
        some = F.size(o["lines"]) > 0
        rest = F.slice(o["lines"], 2, F.greatest(F.size(o["lines"]), F.lit(1)))
        later = F.filter(F.coalesce(F.col("reveal_options"), F.array().cast(_OPTIONS)), lambda r: r["i"] == k)

        def told(parts: Column, after: Column, new: Column) -> Column:
            body = F.when(some, F.concat(F.filter(F.array(parts["first"]), lambda x: x != ""), rest)).otherwise(empty_lines)
            said = F.transform(F.filter(new, lambda n: ~n["right"] & ~n["wrong"]), lambda n: n["x"])
            verdicts = F.filter(new, lambda n: n["right"] | n["wrong"])
            status = F.when(F.size(verdicts) == 0, "").when(F.element_at(verdicts, -1)["right"], "correct").otherwise("wrong")
            marked = F.coalesce(T.marks_right(after["attrs"]), F.lit(False)) if reveal else F.lit(False)
            letter = F.when(some, parts["letter"]).otherwise("?")
            return F.struct(letter.alias("letter"), bilingual(body).alias("text"), status.alias("status"), bilingual(said).alias("explanation"), marked.alias("marked"))

        def of_after(after: Column) -> Column:
            new = F.when(after.isNull(), empty_lines).otherwise(added_lines(o["lines"], after["lines"])) if reveal else empty_lines
            judged = F.transform(new, lambda x: F.struct(x.alias("x"), T.says_right(x).alias("right"), T.says_wrong(x).alias("wrong")))
            return let(T.option_parts(F.get(o["lines"], F.lit(0))), lambda parts: let(judged, lambda n: told(parts, after, n)))

        return let(F.get(later, F.lit(0)), of_after)

    made = base.withColumn("o", F.transform("shown", option))
    by_status = F.transform(F.filter("o", lambda x: x["status"] == "correct"), lambda x: x["letter"])
    by_mark = F.transform(F.filter("o", lambda x: x["marked"]), lambda x: x["letter"])
    correct = F.when(F.size(by_status) > 0, by_status).otherwise(by_mark)
    has = F.size("shown") > 0
    out = made.withColumn("correct", F.when(has, correct).otherwise(empty_lines))
    given = F.size(by_status) > 0
    final = lambda x: F.struct(x["letter"].alias("letter"), x["text"].alias("text"), F.when(~given & F.array_contains("correct", x["letter"]), "correct").otherwise(x["status"]).alias("status"), x["explanation"].alias("explanation"))
    return out.select(
        "capture_id",
        "step",
        F.col("counter.number").alias("number"),
        F.col("counter.total").alias("total"),
        bilingual(stem_of(F.col("pre_lines"))).alias("stem"),
        F.when(has & (F.size(hint_new) > 0) & F.lit(hints), bilingual(hint_new)).alias("hint"),
        F.transform("o", final).alias("options"),
        "correct",
        F.when(~has, F.col("pre_lines")).alias("raw"),
    )


_OPTIONS = "array<struct<i:int,lines:array<string>,attrs:string>>"


def until_repeated(rows: DataFrame) -> DataFrame:
    """Questions of each capture up to the first whose number has come before, or that has none."""
    seen = Window.partitionBy("capture_id", "number").orderBy("step")
    order = Window.partitionBy("capture_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("again", ((F.row_number().over(seen) > 1) | F.col("number").isNull()).cast("int"))
    return marked.withColumn("ended", F.sum("again").over(order)).where("ended = 0").drop("again", "ended")


def checked(rows: DataFrame, reveal: bool = True) -> DataFrame:
    """Questions as they are written: id, question, hint, options with is_correct, answer, and quality codes."""
    nothing = F.struct(F.lit("").alias("en"), F.lit("").alias("ar"))
    option = lambda o: F.struct(o["letter"].alias("key"), o["text"].alias("text"), F.array_contains("correct", o["letter"]).alias("is_correct"), o["explanation"].alias("explanation"))
    q = rows.withColumn("opts", F.coalesce(F.transform("options", option), F.array().cast(_WRITTEN))).withColumn("right", F.filter("opts", lambda o: o["is_correct"]))
    no_ar = F.col("stem.ar") == ""

    def of_option(o: Column) -> Column:
        untold = ~no_ar & (o["text"]["ar"] == "") & ~o["text"]["en"].rlike(f"[{T.ARABIC}]") & ~o["text"]["en"].rlike(FORMULA)
        a = T.ARABIC_LETTER
        lone = F.regexp_replace(o["text"]["ar"], "و", "").rlike(f"(?<![{a}])[{a}](?![{a}])")
        return F.array(F.when(untold, F.concat(F.lit("option_"), o["key"], F.lit("_missing_ar"))), F.when(lone, F.concat(F.lit("option_"), o["key"], F.lit("_lone_arabic_letter"))))

    codes = F.concat(
        F.array(
            F.when(F.size("opts") < 2, "options_lt_2"),
            F.when(F.lit(reveal) & (F.size("correct") == 0), "no_correct_answer"),
            F.when(F.size("correct") > 1, "multiple_correct"),
            F.when((F.col("stem.en") == "") & no_ar, "empty_question"),
            F.when(no_ar & F.exists("opts", lambda o: o["text"]["ar"] != ""), "question_missing_ar"),
        ),
        F.flatten(F.transform("opts", of_option)),
        F.array(F.when(F.lit(reveal) & F.exists("opts", lambda o: (o["explanation"]["en"] == "") & (o["explanation"]["ar"] == "")), "missing_explanation")),
    )
    one = F.size("right") == 1
    answer = F.struct(F.col("correct").alias("keys"), F.when(one, F.get("right", F.lit(0))["text"]).otherwise(nothing).alias("text"), F.when(one, F.get("right", F.lit(0))["explanation"]).otherwise(nothing).alias("explanation"))
    return q.select("capture_id", "step", T.padded_id("q", F.col("number")).alias("id"), "number", "total", F.col("stem").alias("question"), F.coalesce("hint", nothing).alias("hint"), F.col("opts").alias("options"), answer.alias("answer"), F.filter(codes, lambda x: x.isNotNull()).alias("warnings"))


_WRITTEN = "array<struct<key:string,text:struct<en:string,ar:string>,is_correct:boolean,explanation:struct<en:string,ar:string>>>"


def summary(written: DataFrame) -> DataFrame:
    """For each capture: total declared by its first question, questions extracted, and warnings."""
    return written.groupBy("capture_id").agg(F.min_by("total", "step").alias("total_declared"), F.count("*").alias("total_extracted"), F.sum(F.size("warnings")).alias("warnings_count"))


def question_json() -> Column:
    """A written question as JSON."""
    return F.to_json(F.struct("id", "number", "question", "hint", "options", "answer", "warnings"), {"ignoreNullFields": "false"})


def as_json(written: DataFrame) -> DataFrame:
    """capture_id, questions: each capture's questions as one JSON array, in order."""
    rows = F.array_sort(F.collect_list(F.struct("step", question_json().alias("q"))))
    return written.groupBy("capture_id").agg(rows.alias("r")).select("capture_id", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["q"]), ","), F.lit("]")).alias("questions"))


def as_text(rows: DataFrame) -> DataFrame:
    """capture_id, text: a readable rendering of each capture's questions, in order."""

    def indented(pair: Column, pad: str) -> Column:
        return F.transform(F.filter(F.array(pair["en"], pair["ar"]), lambda x: x != ""), lambda x: F.concat(F.lit(pad), x))

    def option(o: Column) -> Column:
        mark = F.when(o["status"] == "correct", "✓ ").when(o["status"] == "wrong", "✗ ").otherwise("  ")
        lines = F.array(F.rtrim(F.concat(mark, o["letter"], F.lit(". "), o["text"]["en"])), F.when(o["text"]["ar"] != "", F.concat(F.lit("      "), o["text"]["ar"])), F.when(o["status"] == "correct", "      ← الإجابة الصحيحة").when(o["status"] == "wrong", "      ← إجابة غير صحيحة (الخيار المنقور)"))
        return F.concat(F.filter(lines, lambda x: x.isNotNull()), indented(o["explanation"], "      ↳ "))

    none = F.array().cast("array<string>")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(F.array(F.concat(F.lit("["), shown("number"), F.lit("/"), shown("total"), F.lit("]"))), indented(F.col("stem"), ""))
    hint = F.when(F.col("hint").isNotNull(), F.concat(F.array(F.lit("تلميح / Hint:")), indented(F.col("hint"), "    "))).otherwise(none)
    options = F.coalesce(F.flatten(F.transform("options", option)), none)
    right = F.when(F.size("correct") > 0, F.array(F.lit(""), F.concat(F.lit("الإجابة الصحيحة: "), F.array_join("correct", ", ")))).otherwise(none)
    raw = F.when(F.size("raw") > 0, F.concat(F.array(F.lit("(لم تُحدَّد الخيارات - النص الخام:)")), F.transform("raw", lambda x: F.concat(F.lit("    "), x)))).otherwise(none)
    lines = F.concat(head, hint, F.array(F.lit("")), options, right, raw, F.array(F.lit(""), F.lit("-" * 40), F.lit("")))
    one = F.struct("step", lines.alias("l"))
    return rows.groupBy("capture_id").agg(F.array_sort(F.collect_list(one)).alias("r")).select("capture_id", F.array_join(F.flatten(F.transform("r", lambda x: x["l"])), "\n").alias("text"))
