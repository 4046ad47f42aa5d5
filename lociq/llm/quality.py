"""Quality rules, line first, in DataFrame functions alone.

Each line is judged by itself: punctuation (no sentence end in a long stretch, shouting, symbols stuck to words),
navigation (menus and separators) and boilerplate (one notice phrase or more for each 40 words). Failing lines are taken out; a document that loses too large
a share of its words is rejected, as is one that fails the base rules on its whole text. Nothing is shuffled: every
figure comes from the row itself.

Defined results: a null or empty text has no words and fails the base rules; a null id is kept as it is; repeated rows
each have their row; an empty table gives an empty result; other columns are not read by `assess`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.session import pick

# Fixed values of the rules: regular expressions as they stand in SQL text.
SPACE = r" \\t\\n\\x0B\\f\\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»·•"
TERMINAL = r"""[.!?…]["\'”’»)\\]]*[ \\t\\x0B\\f\\r]*$"""
SENTENCE = r"[.!?…]([ \\t]|$)"
BOILERPLATE = ("cookie", "javascript", "all rights reserved", "copyright", "©", "terms of use", "terms of service", "privacy policy", "sign up", "log in", "subscribe", "newsletter", "click here", "read more", "lorem ipsum")
WINDOW = 8
#: Words of a line for each notice phrase in it at which it still counts as a notice.
NOTICE = 40


def _count(text: str, chars: str) -> str:
    """SQL: how often characters of a class occur."""
    return f"(char_length({text}) - char_length(regexp_replace({text}, '[{chars}]', '')))"


def _words(line: str) -> str:
    """SQL: number of words of a line that has some."""
    return f"(size(split({line}, '[{SPACE}]+')) - cast({line} rlike '^[{SPACE}]' as int) - cast({line} rlike '[{SPACE}]$' as int))"


def line_fails(max_run: int = 60) -> str:
    """SQL over a line `l`, its number of words `w` and its lower case `s`: it fails a rule."""
    punctuation = f"(not l rlike '{TERMINAL}' and size(regexp_extract_all(l, '{SENTENCE}', 0)) * {max_run} < w)"
    shouting = "(char_length(l) - char_length(replace(l, '!!', ''))) * 5 > 2 * w"
    symbols = f"{_count('l', SYMBOLS)} * 5 > w"
    navigation = f"{_count('l', SEPARATORS)} * 4 >= w"
    notice = f"({' + '.join(f"cast(contains(s, '{x}') as int)" for x in BOILERPLATE)}) * {NOTICE} >= w"
    return " or ".join((navigation, symbols, shouting, punctuation, notice))


def assess(docs: DataFrame, max_lost: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words) of every row."""
    d = pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("ids", F.expr(f"filter(split(text, '[{SPACE}]+'), x -> x <> '')")).withColumnRenamed("ids", "words")
    d = d.withColumn("lines", F.expr(f"filter(split(text, '\\n', -1), l -> l rlike '[^{SPACE}]')"))
    d = d.select(
        "id",
        F.expr("transform(words, x -> xxhash64(x))").alias("ids"),
        "lines",
        F.expr("size(words)").cast("long").alias("n_words"),
        F.expr("char_length(array_join(words, ''))").cast("long").alias("word_chars"),
        F.expr(_count("text", SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr("size(lines) - size(array_distinct(lines))").cast("long").alias("n_dup_lines"),
    )
    item = ", ".join(f"ids[i + {j}]" if j else "ids[i]" for j in range(WINDOW))
    d = d.withColumn("win", F.expr(f"case when size(ids) >= {WINDOW} then transform(sequence(0, size(ids) - {WINDOW}), i -> xxhash64({item})) else cast(array() as array<bigint>) end"))
    d = d.withColumn("sorted", F.expr("case when size(array_distinct(win)) < size(win) then sort_array(transform(win, (h, p) -> struct(h, p))) end")).drop("ids", "win")
    d = d.withColumn("at", F.expr("sort_array(transform(filter(sorted, (s, j) -> get(sorted, j - 1).h = s.h or get(sorted, j + 1).h = s.h), s -> s.p))")).drop("sorted")
    d = d.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate(transform(at, (p, j) -> least({WINDOW}, coalesce(get(at, j + 1), p + {WINDOW}) - p)), 0L, (s, x) -> s + x), 0L)")).drop("at")
    judged = f"transform(lines, l -> struct(l, {_words('l')} as w, lower(l) as s))"
    lost = line_fails()
    d = d.withColumn("judged", F.expr(judged)).drop("lines")
    cond = _over_struct(lost)
    d = d.withColumn("n_lost_words", F.expr(f"aggregate(judged, 0L, (s, x) -> s + case when {cond} then x.w else 0 end)")).drop("judged")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    row = F.struct(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (100 * F.col("n_lost_words") <= max_lost * F.col("n_words"))).alias("kept"), "n_lost_words",
    )
    # The verdict leaves through a generator: what a caller filters or counts then stays above it. Pushed below, each use
    # of a figure would be worked out anew from the text.
    return d.select(F.explode(F.array(row)).alias("row")).select("row.*")


def _over_struct(cond: str) -> str:
    """The line rules with l and w read from the lambda's struct x."""
    return re.sub(r"'(?:[^'\\]|\\.)*'|\b(l|w|s)\b", lambda m: f"x.{m[1]}" if m[1] else m[0], cond)


def cleaned_text(text: str = "text") -> str:
    """SQL: the text without its failing lines; lines without words stay."""
    bad = f"l rlike '[^{SPACE}]' and ({line_fails()})"
    pairs = f"transform(split({text}, '\\n', -1), l -> struct(l, {_words('l')} as w, lower(l) as s))"
    return f"array_join(transform(filter({pairs}, x -> not ({_over_struct(bad)})), x -> x.l), '\\n')"


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT rid, unnest(generate_series(1, len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, hash(list_slice(ws, i, i + 7))) AS c FROM p),
r AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM k WHERE c > 1),
rep AS (SELECT rid, sum(n) AS n FROM r GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
m AS (SELECT rid, l, len(regexp_extract_all(l, '[^ \t\n\x0B\f\r]+')) AS w FROM l),
f AS (SELECT rid, l, w,
  (NOT regexp_matches(l, '[.!?…]["''”’»)\]]*[ \t\x0B\f\r]*$') AND len(regexp_extract_all(l, '[.!?…]([ \t]|$)')) * 60 < w)
  OR (length(l) - length(replace(l, '!!', ''))) * 5 > 2 * w
  OR length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) * 5 > w
  OR length(regexp_replace(l, '[^|>»·•]', '', 'g')) * 4 >= w
  OR len(list_filter(['cookie', 'javascript', 'all rights reserved', 'copyright', '©', 'terms of use', 'terms of service', 'privacy policy', 'sign up', 'log in', 'subscribe', 'newsletter', 'click here', 'read more', 'lorem ipsum'], lambda x: contains(lower(l), x))) * 40 >= w AS bad
  FROM m WHERE w > 0),
g AS (SELECT rid, sum(CASE WHEN bad THEN w ELSE 0 END) AS lost, count(*) - count(DISTINCT l) AS dup FROM f GROUP BY rid),
o AS (SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(d.text, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(g.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(g.lost, 0) AS n_lost_words
  FROM d JOIN w USING (rid) LEFT JOIN g USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= 50 * n_words) AS kept, CAST(n_lost_words AS BIGINT) AS n_lost_words
FROM o"""
