"""Text expressions: lines, ASCII folding, token estimate, log templates, line signals. All are Columns, no Python runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a regular-expression class body, understood alike by Java and RE2; then the same without the line
#: feed, for patterns that look at one line of a text.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_IN_LINE = WS.replace(r"\t-\r", r"\t\x0B-\r")
#: The same white space, each character once.
WS_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# The word lists that line signals and detection look for.
LOG_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL")
SEVERITIES = ("ERROR", "FATAL", "PANIC", "WARN", "WARNING")
ERROR_WORDS = ("error", "err", "failed", "failure", "fatal", "panic", "exception", "traceback", "assert", "refused", "denied", "timeout", "timedout", "unreachable", "corrupt", "invalid", "unauthorized", "forbidden")
WARNING_WORDS = ("warn", "warning", "deprecated", "retry", "retrying", "slow")
SUMMARY_STARTS = ("total", "summary", "passed", "failed", "skipped", "elapsed")
CODE_WORDS = ("fn ", "def ", "class ", "function ", "import ", "from ", "return ", "const ", "let ", "var ", "if (", "if(", "for (", "for(", "while (", "while(", "public ", "private ", "struct ", "impl ", "package ", "func ", "#include", "=>")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(WS_CHARS))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once for a row, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(c: Column) -> Column:
    """Lines without their ends (LF or CRLF); a closing line end adds none; empty text has none."""
    short = lambda n: F.left(c, F.length(c) - n)
    whole = F.when(c.endswith("\r\n"), short(2)).when(c.endswith("\n"), short(1)).otherwise(c)
    # one plain character is looked for: a pattern would be tried at every place
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.replace(whole, F.lit("\r\n"), F.lit("\n")), "\n"))


def has_word(c: Column, *words: str) -> Column:
    """A whole word, where only ASCII letters, digits and _ extend a word."""
    return F.regexp_like(c, F.lit(f"(^|[^0-9A-Za-z_])({'|'.join(words)})($|[^0-9A-Za-z_])"))


def without_strings(c: Column) -> Column:
    """JSON text less its strings. Escapes go first, so that a string is one run of a class: alternatives in a loop would
    take Java's stack a level for each character."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\\.", ""), r'"[^"\x00-\x1F]*+"', "")


#: Stand for escaped backslashes and quotes while a text is cut at its other quotes.
_ESCAPES = (("\\\\", "\ue000"), ('\\"', "\ue001"))


def outside_strings(c: Column, change) -> Column:
    """JSON text with change(part) in place of each part outside its strings; a text that holds one of two private-use
    characters stays as it is."""
    held = c
    for escape, mark in _ESCAPES:
        held = F.replace(held, F.lit(escape), F.lit(mark))
    parts = F.transform(F.split(held, '"'), lambda p, i: F.when(i % 2 == 0, change(p)).otherwise(p))
    out = F.array_join(parts, '"')
    for escape, mark in _ESCAPES:
        out = F.replace(out, F.lit(mark), F.lit(escape))
    return F.when(F.regexp_like(c, F.lit("[\ue000\ue001]")), c).otherwise(out)


def is_json(c: Column) -> Column:
    """The whole text, less white space at its ends, is one JSON object or array; false for null.

    Wrapped in an array and in an object it must stay one element and one member, which rules out anything behind it; what
    stands outside strings must be JSON's own characters, which rules out the reader's leniencies.
    """
    t = strip(c)
    bare = without_strings(t)
    one = (F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"a":'), t, F.lit("}")))) == 1)
    strict = F.regexp_like(bare, F.lit(r"^[\[\]{},:0-9eE+\-.aflnrstu \t\r\n]*\z"))
    return F.when(F.regexp_like(t, F.lit(r"(?s)^(\{.*\}|\[.*\])\z")), F.coalesce(one & strict, F.lit(False))).otherwise(F.lit(False))


def estimated_tokens(c: Column) -> Column:
    """Estimate of a text's model tokens by character class; null for null, 0 for empty, else at least 1.

    Letters and spaces, of which most texts consist, go in one pass of few matches; classes are told apart in what is left. Only
    words and runs of white space that are long enough to count otherwise are looked at again.
    """
    without = lambda text, chars: F.regexp_replace(text, f"[{chars}]+", "")
    # in one pass: each stretch of one character becomes a mark
    changes = lambda run: F.length(F.regexp_replace(run, r"(?s)(.)\1*+", "x")) - 1
    # beyond what one piece of white space counts, less its other characters, each of which is counted at first
    of_run = lambda a, r: a + F.floor(F.length(r) / 8).cast("int") + F.ceil(changes(r) / 2).cast("int") - (F.length(r) - 1)
    of_letters = lambda a, s: a + let(F.length(without(s, "^A-Za-z")), lambda n: F.when(n > 12, n).otherwise(0))
    rare = lambda odd: F.regexp_like(odd, F.lit(f"[{WS_IN_LINE}]"))

    def dense(odd: Column) -> Column:
        words = F.array_join(F.filter(F.split(F.replace(c, F.lit("\n"), F.lit(" ")), " "), lambda w: F.octet_length(w) > 12), " ")
        # of a text whose white space is spaces already: a class of one character is tried at every place of every word
        plain = let(words, lambda w: F.when(rare(odd), F.regexp_replace(w, f"[{WS}0-9]+", " ")).otherwise(F.regexp_replace(w, "[0-9]+", " ")))
        return F.aggregate(F.regexp_extract_all(plain, F.lit("([^ ]{13,})")), F.lit(0), of_letters)

    def space(odd: Column, dark: Column) -> Column:
        """Pieces of white space less spaces; odd: what a text holds beside ASCII's letters, digits, signs and spaces; dark: that less white space."""
        every = lambda chars: F.regexp_extract_all(c, F.lit(f"([{chars}]{{2,}})"))
        pairs = contains_any(c, *(a + b for a in " \n" for b in " \n"))
        runs = F.when(rare(odd), every(WS)).when(pairs, every(r" \n")).otherwise(F.array().cast("array<string>"))
        return F.length(odd) - F.length(dark) + F.aggregate(runs, F.lit(0), of_run)

    def total(x: Column) -> Column:
        letters, digits = x["size"] - x["spaces"] - x["rest"], x["rest"] - x["signs"]
        punct = x["signs"] - x["odd"] + x["dark"] - x["wide"]
        summed = F.ceil(2 * (letters - x["dense"]) / 7) + F.ceil(digits / 2) + F.ceil(2 * x["dense"] / 3) + punct + 2 * x["wide"] + x["spaces"] + x["space"]
        return F.greatest(F.lit(1), summed)

    def measured(rest: Column, signs: Column, odd: Column, dark: Column) -> Column:
        sizes = {k: F.length(v) for k, v in (("size", c), ("rest", rest), ("signs", signs), ("odd", odd), ("dark", dark), ("wide", without(dark, r"\x00-\x7F")))}
        sizes |= {"spaces": F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))), "space": space(odd, dark), "dense": dense(odd)}
        return let(F.struct(*[v.alias(k) for k, v in sizes.items()]), total)

    # each text is what the one before leaves, and is worked out once
    found = let(without(c, "A-Za-z "), lambda rest: let(without(rest, "0-9"), lambda signs: let(without(signs, r"!-/:-@\[-`{-~"), lambda odd: let(without(odd, WS), lambda dark: measured(rest, signs, odd, dark)))))
    return F.when(c.isNull(), F.lit(None)).when(c == "", F.lit(0)).otherwise(found).cast("long")


def template(line: Column) -> Column:
    """A line with its variable tokens replaced: <ts>, <uuid>, <hex>, <n>, <path>."""
    digits = lambda t: F.regexp_count(t, F.lit("[0-9]"))

    def shape(core: Column) -> Column:
        is_ts = F.regexp_like(core, F.lit(r"^[-0-9:TZ.+]{8,}\z")) & (digits(core) >= 4) & (F.regexp_count(core, F.lit("[-:TZ.+]")) >= 2)
        is_uuid = F.regexp_like(core, F.lit(r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z"))
        is_hex = F.regexp_like(core, F.lit(r"^0[xX][0-9A-Fa-f]+\z")) | (F.regexp_like(core, F.lit(r"^[0-9A-Fa-f]{12,}\z")) & F.regexp_like(core, F.lit("[A-Fa-f]")))
        is_number = F.regexp_like(core, F.lit(r"^[-+]?[0-9.]*[0-9][0-9.]*(%|[A-Za-z]{1,3})?\z"))
        is_path = F.regexp_like(core, F.lit(r"[/\\]")) & (F.octet_length(core) > 1) & ~F.startswith(core, F.lit("//")) & F.regexp_like(core, F.lit("[0-9A-Za-z]"))
        return F.when(is_ts, "<ts>").when(is_uuid, "<uuid>").when(is_hex, "<hex>").when(is_number, "<n>").when(is_path, "<path>").otherwise(core)

    part = r"""^([(\[{"'<]*)(.*?)([)\]}"'>,;:.]*)\z"""

    def token(run: Column) -> Column:
        shaped = let(F.regexp_extract(run, part, 2), lambda core: F.when(core == "", run).otherwise(F.concat(F.regexp_extract(run, part, 1), shape(core), F.regexp_extract(run, part, 3))))
        # what varies has a digit or a slash, or is a name of twelve characters or more
        return F.when(F.regexp_like(run, F.lit(rf"[0-9/\\]|^[^{WS}]{{12}}")), shaped).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(line, F.lit(f"([^{WS}]+|[{WS}]+)")), token), "")


#: Beginnings of which every keyword holds one; looked for without regard to the case of ASCII letters.
_KEYWORD_PARTS = ("err", "fail", "fatal", "panic", "exception", "traceback", "assert", "refused", "denied", "time", "unreach", "corrupt", "invalid", "unauth", "forbid", "warn", "deprec", "retry", "slow")


def keyword_score(line: Column) -> Column:
    """3 for each error word and 1 for each warning word that a line holds as a whole word."""
    held = lambda words, names: F.size(F.array_intersect(words, F.array(*[F.lit(n) for n in names])))
    scored = let(F.split(ascii_lower(line), "[^0-9a-z_]+"), lambda words: 3 * held(words, ERROR_WORDS) + held(words, WARNING_WORDS))
    # plain searches, many times cheaper than one pattern of them all; what lower case makes of other letters does no harm here
    some = let(F.lower(line), lambda low: contains_any(low, *_KEYWORD_PARTS))
    return F.when(some, scored).when(line.isNotNull(), F.lit(0))


def contains_any(c: Column, *parts: str) -> Column:
    out = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(c, F.lit(p))
    return out


def starts(c: Column, *parts: str) -> Column:
    out = F.startswith(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.startswith(c, F.lit(p))
    return out


def importance(line: Column, score: Column | None = None) -> Column:
    """critical, notable or routine; score: the line's keyword score, where a column already holds it."""
    t = strip(line)
    score = keyword_score(line) if score is None else score
    notable = (score > 0) | starts(t, "#", "==", "--") | F.endswith(t, F.lit(":")) | F.regexp_like(t, F.lit(f"(?i)^({'|'.join(SUMMARY_STARTS)})"))
    return F.when(score >= 3, "critical").when((t != "") & notable, "notable").otherwise("routine")


def tags(line: Column) -> Column:
    """Names of markup tags that open or close on a line; self-closing, ! and ? tags are not counted."""
    raw = F.regexp_extract_all(line, F.lit("<([^>]*)>"))
    name = lambda t: F.regexp_extract(t, f"^/?([A-Za-z][A-Za-z0-9_-]*)(?:[{WS}]|$)", 1)
    named = F.filter(F.transform(F.filter(raw, lambda t: ~F.endswith(t, F.lit("/"))), name), lambda n: n != "")
    return F.when(F.contains(line, F.lit("<")), named).when(line.isNotNull(), F.array().cast("array<string>"))


def content_hash(c: Column) -> Column:
    """32 lower-case hex digits that name a content (a SHA-256 prefix)."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 32)


def marker(c: Column) -> Column:
    return F.concat(F.lit("<<ccr:"), content_hash(c), F.lit(">>"))


def find_markers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("<<ccr:([0-9a-f]{32})>>"))


def model_family(model: Column) -> Column:
    """Up to two leading name segments before an empty or digit-led one; unknown where there is none."""
    m = F.regexp_extract(model, r"^([^-.:0-9][^-.:]*(?:[-.:][^-.:0-9][^-.:]*)?)", 1)
    return F.when(F.coalesce(m, F.lit("")) == "", "unknown").otherwise(F.regexp_replace(m, "[.:]", "-"))
