"""SQL pieces for DuckDB, with the same patterns and definitions as the column functions."""

from __future__ import annotations

from textlake.functions import patterns as P


def q(pattern: str) -> str:
    """A pattern or string as a literal."""
    return "'" + pattern.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def without(x: str, *found: str) -> str:
    for pattern in found:
        x = sub(x, pattern)
    return x


def collapse(x: str) -> str:
    return f"trim({sub(x, P.WS + '+', ' ')})"


def strip(x: str) -> str:
    return sub(x, f"^{P.WS}+|{P.WS}+$")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(P.NON_WS + '+')})"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def sentences(x: str) -> str:
    x = collapse(x)
    for end in (P.ABBREVIATION_END, P.TITLE_END):
        x = sub(x, end, "\\1\u0001")
    x = f"replace({sub(x, P.SENTENCE_END, chr(92) + '1' + chr(2))}, chr(1), ' ')"
    return f"list_filter(string_split({x}, chr(2)), lambda s: s <> '')"


#: Entities that the tables hold; SQL has one pass for each.
SHOWN = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot")


def html(x: str) -> str:
    x = without(x, P.HTML_COMMENT, P.HTML_DROPPED, P.HTML_TAG)
    for name, character in sorted(P.ENTITIES.items(), key=lambda e: (e[0] == "amp", e[0])):  # the ampersand last
        if name in SHOWN:
            x = f"replace({x}, '&{name};', {q(character)})"
    return x


def urls(x: str) -> str:
    return without(x, P.URL, P.WWW, P.SHORTENER, P.EMAIL)


def special(x: str) -> str:
    return sub(sub(without(x, P.EMOJI, P.EMOTICON), P.PUNCTUATION_RUN, r"\1"), P.NON_LATIN, " ")


def normalize(x: str) -> str:
    return without(sub(x, r"\r\n?", "\n"), P.CONTROL)


def noise(x: str) -> str:
    """Without the step that collapses repeated characters, which needs a reference within a pattern."""
    return without(x, P.DELETED, P.POSTED_BY, P.SUBREDDIT, *P.BOILERPLATE)


def whitespace(x: str) -> str:
    return strip(sub(sub(f"replace({x}, chr(9), ' ')", " +", " "), r"\n+", "\n"))


def clean(x: str) -> str:
    return whitespace(noise(normalize(special(urls(html(f"coalesce({x}, '')"))))))


def repeats_ctes(source: str, key: str, column: str, out: str) -> str:
    """CTEs up to ``out`` (key, t), in which runs of four or more of a character are two of them: by the lengths of the runs."""
    return f"""{out}_c AS (SELECT {key}, unnest(range(len(a))) AS i, unnest(a) AS c FROM (SELECT {key}, regexp_extract_all({column}, '(?s).') AS a FROM {source})),
    {out}_g AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, c ORDER BY i) AS g FROM {out}_c),
    {out}_n AS (SELECT *, count(*) OVER (PARTITION BY {key}, c, g) AS n, row_number() OVER (PARTITION BY {key}, c, g ORDER BY i) AS k FROM {out}_g),
    {out}_j AS (SELECT {key}, string_agg(c, '' ORDER BY i) AS t FROM {out}_n WHERE n < 4 OR k <= 2 OR c = chr(10) GROUP BY {key}),
    {out} AS (SELECT x.{key}, coalesce(j.t, '') AS t FROM {source} x LEFT JOIN {out}_j j USING ({key}))"""


def clean_ctes(source: str, key: str, column: str, out: str = "cleaned") -> str:
    """CTEs up to ``out`` (key, t): all cleaning steps, with that for repeated characters."""
    first = noise(normalize(special(urls(html(f"coalesce({column}, '')")))))
    return f"""{out}_a AS (SELECT {key}, {first} AS t FROM {source}), {repeats_ctes(f'{out}_a', key, 't', f'{out}_r')}, {out} AS (SELECT {key}, {whitespace('t')} AS t FROM {out}_r)"""


def reason(x: str) -> str:
    """The first rule that fails, over a column x that isn't null."""
    solid = f"length(replace({x}, ' ', ''))"
    return f"""CASE WHEN {x} = '' THEN 'empty' WHEN length({x}) < 50 THEN 'too_short' WHEN length({x}) > 10000 THEN 'too_long'
        WHEN {solid} > 0 AND {count(x, P.LETTER)} / {solid} < 0.7 THEN 'low_alpha_ratio'
        WHEN {count(x, r'[{};[]')} > length({x}) / 50 THEN 'code_like'
        WHEN {n_words(x)} > 10 AND len(list_distinct({words(x)})) / {n_words(x)} < 0.3 THEN 'repetitive' ELSE 'valid' END"""


def accepted(x: str, least: int = 15, most: int = 10_000, unique: float = 0.25, alpha: float = 0.7, chars: int = 50, ends: bool = False) -> str:
    made = [f"length({strip(x)}) >= {chars}", f"{n_words(x)} BETWEEN {least} AND {most}"]
    if unique:
        made.append(f"coalesce(len(list_distinct({words(x)})) / nullif({n_words(x)}, 0), 0) >= {unique}")
    if alpha:
        made.append(f"coalesce(({count(x, P.LETTER)} + {count(x, P.WS)}) / nullif(length({x}), 0), 0) >= {alpha}")
    if ends:
        made.append(f"right({x}, 1) IN ('.', '!', '?')")
    return f"({' AND '.join(made)})"


def rounded(x: str, digits: int) -> str:
    """Half up on the shortest decimal form, as Spark rounds doubles."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def rank_hash(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


def label(x: str, table: tuple, sign: str) -> str:
    *rows, (_, rest) = table
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} {sign} {bound} THEN {q(name)}" for bound, name in rows) + f" ELSE {q(rest)} END"


def bins(x: str, table: tuple) -> str:
    *rows, (_, rest) = table
    return "CASE " + " ".join(f"WHEN {x} <= {high} THEN {q(name)}" for high, name in rows) + f" ELSE {q(rest)} END"


def chance(seed: int, *parts: str) -> str:
    made = " || '|' || ".join(f"CAST({x} AS VARCHAR)" for x in parts)
    return f"CAST('0x' || substr(md5({made} || '|{seed}'), 1, 2) AS INTEGER)"


def lower_first(x: str) -> str:
    return f"lower(substr({x}, 1, 1)) || substr({x}, 2)"


def syllables(x: str) -> str:
    low = f"lower({x})"
    bare = f"list_filter(string_split({collapse(sub(low, P.VOWELS, '#'))}, ' '), lambda w: w <> '' AND NOT contains(w, '#'))"
    return f"({count(low, P.VOWELS)} + len({bare}))"


#: doc_id, lengths, n, s, v for each document: sentence lengths, their number, sum and sum of squares.
LENGTHS = f"""SELECT doc_id, lengths, CAST(len(lengths) AS BIGINT) AS n, coalesce(list_sum(lengths), 0) AS s, coalesce(list_sum(list_transform(lengths, lambda x: x * x)), 0) AS v
    FROM (SELECT doc_id, list_transform({sentences("coalesce(text, '')")}, lambda t: {n_words("t")}) AS lengths FROM documents)"""
MEAN = "CASE WHEN n > 0 THEN s / n ELSE 0.0 END"
VARIANCE = "CASE WHEN n > 0 THEN (n * v - s * s) / (n * n) ELSE 0.0 END"
DEVIATION = f"sqrt({VARIANCE})"
BURSTINESS = f"CASE WHEN n < 2 OR ({DEVIATION}) + ({MEAN}) = 0 THEN 0.0 ELSE {rounded(f'({DEVIATION} - ({MEAN})) / ({DEVIATION} + ({MEAN}))', 4)} END"
CV = f"CASE WHEN n < 2 OR ({MEAN}) = 0 THEN 0.0 ELSE {rounded(f'{DEVIATION} / ({MEAN}) * 100', 2)} END"
DIFFS = "list_transform(range(1, len(lengths)), lambda i: abs(lengths[i + 1] - lengths[i]))"
EASE = f"CASE WHEN n > 0 AND w > 0 THEN {rounded('CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * (w / n) - CAST(84.6 AS DOUBLE) * (y / w)', 2)} ELSE 0.0 END"
GRADE = f"CASE WHEN n > 0 AND w > 0 THEN {rounded('CAST(0.39 AS DOUBLE) * (w / n) + CAST(11.8 AS DOUBLE) * (y / w) - CAST(15.59 AS DOUBLE)', 2)} ELSE 0.0 END"
#: The same with words and syllables.
READING = f"SELECT l.*, {n_words("coalesce(text, '')")} AS w, {syllables("coalesce(text, '')")} AS y FROM ({LENGTHS}) l JOIN documents USING (doc_id)"
