"""Text expressions on hand cases."""

from pyspark.sql import functions as F

from textloom.functions import text as T


def one(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_lines(spark):
    assert one(spark, T.lines, ["", "a", "a\n", "a\n\nb", "a\r\nb\r\n", "\n"]) == [[], ["a"], ["a"], ["a", "", "b"], ["a", "b"], [""]]


def test_word_bounds_are_ascii(spark):
    assert one(spark, lambda c: T.has_word(c, "ERROR"), ["ERROR x", "éERROR", "xERROR", "ERROR_", "(ERROR)"]) == [True, True, False, False, True]


def test_token_estimate(spark):
    assert one(spark, T.estimated_tokens, ["", " ", "EYM3Dgnc6", None, "ééé", "a" * 13]) == [0, 1, 3, None, 6, 9]


def test_long_runs_of_letters_end_at_any_white_space_and_digit(spark):
    # 13 letters and more count at another rate; signs belong to the run, white space and digits end it
    assert one(spark, T.estimated_tokens, ["a" * 12, "a" * 13, "a" * 12 + "\u00a0" + "a" * 12, "a" * 12 + "1" + "a" * 12, "a" * 7 + "-" + "a" * 7, "\u3000" + "b" * 14 + "\t"]) == [4, 9, 8, 8, 11, 12]


def test_token_estimate_costs_a_few_passes(spark):
    """Of words of common length; a pattern that is tried anew at every letter took some 20 passes."""
    import time

    df = spark.createDataFrame([("the number of words that occur in ordinary writing, " * 400,)] * 200, "t string").coalesce(1).cache()

    def took(c):
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            df.agg(F.sum(c)).collect()
            runs.append(time.perf_counter() - began)
        return min(runs)

    assert took(T.estimated_tokens(F.col("t"))) < 9 * took(F.length(F.regexp_replace("t", f"[{T.WS}]+", " ")))


def test_token_estimate_of_plain_prose_costs_about_one_pass(spark):
    """Where words lie one space apart; a class of all white space over the whole text, twice and more, took 2.5 passes."""
    import time

    df = spark.range(2000).select(F.concat(F.lit("id "), F.col("id").cast("string"), F.repeat(F.lit(" some plain words of prose, and a name."), F.lit(200))).alias("t")).repartition(8).cache()

    def took(c):
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            df.agg(F.sum(c)).collect()
            runs.append(time.perf_counter() - began)
        return min(runs)

    assert took(T.estimated_tokens(F.col("t"))) < 1.9 * took(F.length(F.regexp_replace("t", f"[{T.WS}]+", " ")))


def test_token_estimate_of_rare_white_space_and_of_signs(spark):
    texts = ["a b", "a  b", "a\n\nb", "a \nb", "a\u00a0\u00a0b", " " * 9, "\n" * 8, "\x1c~", "a" * 7 + "\n" + "a" * 7, "a" * 7 + "\r" + "a" * 7]
    assert one(spark, T.estimated_tokens, texts) == [2, 2, 2, 3, 2, 2, 2, 2, 5, 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert df.where(~T.estimated_tokens(F.col("t")).eqNullSafe(F.expr(_tokens_function(spark)))).count() == 0


def _tokens_function(spark):
    from textloom.functions import sql

    sql.register(spark)
    return "condense_tokens(t)"


def test_template(spark):
    got = one(spark, T.template, ["2026-08-03T12:00:00Z INFO worker 17 took 30ms", "id=0xff (0x1F), a/b/c", "deadbeefcafe1 550e8400-e29b-41d4-a716-446655440000", "+--+ ."])
    assert got == ["<ts> INFO worker <n> took <n>", "id=0xff (<hex>), <path>", "<hex> <uuid>", "+--+ ."]


def test_importance_and_tags(spark):
    assert one(spark, T.importance, ["an error here", "slow path", "# head", "plain", "", "done:"]) == ["critical", "notable", "notable", "routine", "routine", "notable"]
    assert one(spark, T.tags, ["<a href=x>y</a>", "<br/> <!-- x --> <?php ?>", "1 < 2"]) == [["a", "a"], [], []]


def test_model_family(spark):
    assert one(spark, T.model_family, ["claude-opus-4-20250514", "gpt-4o", "4all", "", "o3"]) == ["claude-opus", "gpt", "unknown", "unknown", "o3"]


def test_markers(spark):
    assert one(spark, T.find_markers, ["see <<ccr:" + "ab" * 16 + ">> and <<ccr:" + "AB" * 16 + ">>", "none"]) == [["ab" * 16], []]


def test_line_signals_by_plain_search_agree_with_patterns(spark):
    from pyspark.sql import functions as F

    from textloom.functions import text as T
    from textloom.operators.signals import anchor

    lines = ["", " ", "　x ", "x:", " x: ", "## a", "#", "#x", "====", "== a", "--", "----", "---x", "at z", "at", 'File "q', "see a.py:3 ok", "a.py:", "f(", " [ ", "} {", "ERROR", "a tIMEOUT b", "İerr", "err", "SLOWly slow", "<a><b/>", "x > y", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    t = F.btrim("line", F.lit(T.WS_CHARS))
    frame = F.regexp_like(t, F.lit(r"""^(at |File ")|[A-Za-z0-9_]\.[A-Za-z]+:[0-9]+"""))
    slow = F.when(F.startswith("line", F.lit("@@")), "hunk_header").when(F.startswith(t, F.lit("```")), "fence").when(F.regexp_like(t, F.lit(r"^(#+ .+|={3,}|-{3,})$")), "heading").when(frame, "stack_frame").when(F.regexp_like(t, F.lit(r"[\[{(]$")), "structure_open")
    score = F.size(F.array_intersect(F.split(T.ascii_lower(F.col("line")), "[^0-9a-z_]+"), F.array(*map(F.lit, T.ERROR_WORDS)))) * 3 + F.size(F.array_intersect(F.split(T.ascii_lower(F.col("line")), "[^0-9a-z_]+"), F.array(*map(F.lit, T.WARNING_WORDS))))
    pairs = {"strip": (T.strip(F.col("line")), t), "anchor": (anchor(F.col("line"), F.lit(False)), slow), "score": (T.keyword_score(F.col("line")), score), "tags": (F.size(T.tags(F.col("line"))), F.when(F.col("line") == "<a><b/>", 1).when(F.col("line").isNotNull(), 0))}
    for name, (quick, plain) in pairs.items():
        assert df.where(~quick.eqNullSafe(plain)).collect() == [], name


def test_keywords_are_looked_for_by_plain_search(spark):
    from pyspark.sql import functions as F

    from textloom.functions import text as T

    assert "RLIKE" not in str(T.keyword_score(F.col("x"))._jc.toString()).upper()


def test_a_vocabulary_is_read_once_a_process():
    from textloom.operators import bodies

    assert bodies._counting("byte_bpe_50k") is bodies._counting("byte_bpe_50k")
