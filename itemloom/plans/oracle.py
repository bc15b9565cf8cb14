"""The queries' twins in DuckDB's SQL, put together from the same fixed values but independently of the Spark expressions."""

from __future__ import annotations

from ..functions.charclass import NOT_S, NOT_W, S, S_IN, D, W, quoted, sql_all, sql_blank, sql_count, sql_doubled, sql_isolated, sql_strip
from ..functions.vocab import DOMAINS, KEYWORDS, MODEL_NAMES, PHRASES, SINGLE_TERMS, SYMBOLS, models_sql, vocabulary_sql

# ---------------------------------------------------------------- the item corpus, one text for both engines

ITEM_PARTS = ["o_orderkey", "cast(o_orderkey % 97 + 1 as varchar(20)) as q", "cast(o_custkey % 9 + 1 as varchar(20)) as n", "cast(o_custkey % 50 + 3 as varchar(20)) as p"]
ITEM_TEXT = """case o_orderkey % 12
 when 0 then concat('Divide. ', q, ' / ', n, ' =')
 when 1 then concat('Solve ', q, 'x + ', n, ' = ', p, ' for x.')
 when 2 then concat('Find the area of a rectangle with base ', q, ' and height ', n, '. Even or odd?')
 when 3 then concat('What is ', q, '/', n, ' of ', p, '%? The common denominator is a factor.')
 when 4 then concat('The mean and median of the data are ', q, '.', n, ' and ', p, '. A) D+', n, ' B) D-', n, ' C) D*', n, ' D) D/', n)
 when 5 then concat('Is ', q, ' ≤ ', n, ' or ', q, ' > ', p, '? The ratio is ', q, ':', n)
 when 6 then concat('Evaluate $x^', n, ' + y^', n, '$ and ', chr(92), 'frac{', q, '}{', n, '}, ∫ f', chr(39), '(x), ', q, ' × 10^', n)
 when 7 then concat('Read the passage about towns. It has ', q, ' well-known streets; choose two.')
 when 8 then concat('Add ', q, ' + ', n, ' - ', p, ' and ', q, '−', n, '. Simplify a^2 + b, x**', n, ' and g(x)h(y)! A) yes B) no E) none')
 when 9 then concat('The limit ', chr(92), 'lim f(t), lim_{x} and ', chr(92), 'sum of ', q, ': standard deviation, rate of change, place value, mixed number, d/dx. It rose ', n, '.5% at 10:30.')
 when 10 then concat('Compute ٣ + ', n, ', √', q, ' ≈ π ≠ ∞ ÷ 2·', p, '. I have a cat, Dwayne', chr(39), 's y and x² été t.')
 else concat('  ', chr(9), ' ') end"""
ITEMS = f"items as (select o_orderkey as item_id, {ITEM_TEXT} as txt from (select {', '.join(ITEM_PARTS)} from orders) z)"

RESPONSE_PARTS = ["o_orderkey", "o_orderkey % 8 as k", "cast(o_custkey % 9 + 1 as varchar(20)) as n"]
CLASSIFY_TEXT = """case k
 when 0 then concat('{"table": true, "array": "false", "number_line": 0, "primary": "table"}')
 when 1 then concat('```json', chr(10), '{"bar_graph": 1, "other": [], "picture": "", "primary": "zzz"}', chr(10), '```')
 when 2 then 'no json here'
 when 3 then concat('Here you are: {"histogram": true, "dot_plot": true, "primary": "histogram", "note": "', n, '"} thanks')
 when 4 then '{bad'
 when 5 then '{"primary": "text_only", "picture": null, "array": {}, "table": "yes"}'
 when 6 then concat('{"scatter_plot": ', n, ', "tree_diagram": 0.0}')
 else '' end"""
OCR_TEXT = """case k
 when 0 then concat('{"full_text": "Find ', n, '", "extraction_confidence": 0.', n, '}')
 when 1 then '{"full_text": "hi", "image_description": "a line"}'
 when 2 then concat('plain words ', n, ' and x')
 when 3 then '?? !'
 when 4 then concat('```json', chr(10), '{"content_type": "mixed", "full_text": "t", "labels": ["a", "b"]}', chr(10), '```')
 when 5 then '{"image_description": "only a picture"}'
 when 6 then concat('{bad ', n, 'x')
 else '{"full_text": null}' end"""


def responses(text: str) -> str:
    return f"resp as (select o_orderkey as item_id, {text} as raw from (select {', '.join(RESPONSE_PARTS)} from orders) z)"


# ---------------------------------------------------------------- expressions over a column t

# Fixed values, spelled out again so that the twin does not follow the code under test.
LATEX = [r"\$\$[\s\S]*?\$\$", r"\$[\s\S]*?\$", r"\\\([\s\S]*?\\\)", r"\\\[[\s\S]*?\\\]", r"\\frac\{[\s\S]*?\}\{[\s\S]*?\}", r"\\sqrt\{[\s\S]*?\}", r"\\begin\{equation\}[\s\S]*?\\end\{equation\}"]
COMMANDS = r"\\(?:int|sum|lim|log|ln|sin|cos|tan)"
OPERATORS = r"[+\-−×*·÷/=<>≤≥≈^]"
SECRETS = r"AIza[A-Za-z0-9_-]{30,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}"
ARABIC = "translate({}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
PAD = "regexp_replace({}, '\\)', ')  ', 'g')"
PLAIN: dict[str, str] = {
    "addition": rf"{D}+{S}*\+{S}*{D}+",
    "subtraction": rf"{D}+{S}*[-−]{S}*{D}+",
    "multiplication": rf"{D}+{S}*[×*·]{S}*{D}+",
    "division": rf"{D}+{S}*[÷/]{S}*{D}+",
    "variable": "",
    "equation": r"[^=]+=[^=]+",
    "inequality": r"[^<>=]+[<>≤≥][^<>=]+",
    "exponent": rf"{W}+(?:\^|\*\*)[\p{{L}}\p{{N}}_{{}}]+",
    "function": rf"(?:^|{NOT_W})[a-zA-Z]+\([^)]+\)",
    "polynomial": rf"[a-z]\^?{D}*{S}*[+\-]{S}*[a-z]\^?{D}*",
    "fraction": rf"{D}+/{D}+|\\frac\{{{D}+\}}\{{{D}+\}}",
    "decimal": rf"{D}+\.{D}+",
    "percentage": rf"{D}+\.?{D}*%",
    "ratio": rf"{D}+:{D}+",
    "scientific_notation": rf"{D}+\.?{D}*{S}*[×x]{S}*10\^-?{D}+",
    "derivative": r"d/dx|f'|\\frac\{d\}\{dx\}",
    "integral": r"∫|\\int",
    "limit": r"\\lim|lim_",
    "summation": r"∑|\\sum",
}
LETTER = sql_isolated("[A-HJ-Zb-z]")


def pattern(name: str, t: str = "t") -> str:
    if name == "variable":
        return sql_count(sql_doubled(t), LETTER)
    return sql_count(PAD.format(t) if name == "function" else t, PLAIN[name])


def variables(t: str = "t") -> str:
    return f"list_sort(list_distinct({sql_all(sql_doubled(t), LETTER, 1)}))"


def number_list(t: str = "t") -> str:
    return f"list_transform({sql_all(t, rf'-?{D}+\.?{D}*')}, lambda x: cast({ARABIC.format('x')} as double))"


def words(t: str = "t") -> str:
    return sql_count(t, f"{NOT_S}+")


def sentences(t: str = "t") -> str:
    return f"greatest(1, len(list_filter(string_split_regex({t}, '[.!?]+'), lambda x: regexp_matches(x, {quoted(NOT_S)}))))"


def symbol(name: str, t: str = "t") -> str:
    return f"length(regexp_replace({t}, '[^{SYMBOLS[name].replace('-', chr(92) + '-')}]', '', 'g'))"


def tokens(t: str = "lower(t)") -> str:
    return sql_all(t, f"{W}+")


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def among(tokens_: str, values: list[str]) -> str:
    return f"list_filter({tokens_}, lambda x: list_contains({listed(values)}, x))"


def phrase(p: str, lower: str = "lower(t)") -> str:
    return sql_count(sql_doubled(lower), sql_isolated(p.replace(" ", "  ")))


def normalized(t: str = "t") -> str:
    for p in LATEX:
        t = f"regexp_replace({t}, {quoted(p)}, ' MATH ', 'g')"
    t = f"regexp_replace({t}, {quoted(COMMANDS)}, ' MATH ', 'g')"
    t = f"regexp_replace({t}, {quoted(OPERATORS)}, ' ', 'g')"
    t = f"regexp_replace({t}, {quoted(f'(^|{NOT_W})[A-D][.)]{S}*')}, '\\1', 'g')"
    return sql_strip(f"regexp_replace({t}, {quoted(f'{S}+')}, ' ', 'g')")


def syllables(t: str) -> str:
    each = "len(regexp_extract_all(w, '[aeiou]+'))"
    return f"cast(coalesce(list_sum(list_transform({sql_all(f'lower({t})', f'{NOT_S}+')}, lambda w: greatest(1, {each} - case when w like '%e' and {each} > 1 then 1 else 0 end))), 0) as integer)"


def per(a: str, b: str) -> str:
    return f"coalesce(cast({a} as double) / nullif(cast({b} as double), 0), 0)"


#: From a source with columns id and txt: t (blank texts empty), then the counts, then the features.
def content(source: str) -> str:
    d = {k: v for k, v in DOMAINS.items()}
    singles = {k: [t for t in v if " " not in t] for k, v in d.items()}
    phrases = {k: [t for t in v if " " in t] for k, v in d.items()}
    column = {p: f"ph_{k}" for k, p in enumerate(PHRASES)}
    bonus = {"calculus": "derivative + pat_integral", "fractions": "fraction", "algebra": "equation + pat_variable"}
    score = lambda k: " + ".join([f"len({among('tok', singles[k])})", *[column[p] for p in phrases[k]], *([f"case when pat_{bonus[k]} > 0 then 1 else 0 end"] if k in bonus else [])])
    return f"""
s0 as (select id, case when {sql_blank('txt')} then '' else txt end as t, {sql_blank('txt')} as blank from {source}),
s1 as (select *, {number_list()} as nums, {words()} as wc, {tokens()} as tok, {', '.join(f'{pattern(p)} as pat_{p}' for p in PLAIN)}, {', '.join(f'{symbol(s)} as sym_{s}' for s in SYMBOLS)}, {', '.join(f'{phrase(p)} as {c}' for p, c in column.items())} from s0),
s2 as (select *, {among('tok', SINGLE_TERMS)} as hits, {' + '.join(column.values())} as phrase_hits, {' + '.join(f'(case when {c} > 0 then 1 else 0 end)' for c in column.values())} as phrase_kinds, {', '.join(f'{score(k)} as score_{k}' for k in d)} from s1),
s3 as (select *, greatest({', '.join(f'score_{k}' for k in d)}) as best, {' + '.join(f'score_{k}' for k in d)} as total,
  list_transform(list_sort([{', '.join("{'m': -score_" + k + ", 'o': " + str(i) + ", 'd': '" + k + "'}" for i, k in enumerate(d))}]), lambda x: x.d) as ranked from s2)"""


def readability(source: str = "s0") -> str:
    return f"""
r0 as (select id, blank, {normalized()} as norm from {source}),
r1 as (select id, blank, norm, {words('norm')} as rw, {sentences('norm')} as rs, length(regexp_replace(norm, {quoted(S)}, '', 'g')) as rc, {syllables('norm')} as ry from r0),
r2 as (select *, {per('rw', 'rs')} as asl, {per('ry', 'rw')} as asw, {per('rc', 'rw')} as awl from r1),
r3 as (select *, greatest(1.0, least(16.0, awl * 1.5 + asl * 0.3 - 3.0)) as grade, greatest(0.0, least(100.0, 206.835 - 1.015 * asl - 84.6 * asw)) as ease from r2)"""


#: Added before rounding, since engines break decimal ties of doubles differently.
NUDGE = 1e-9


def rounded(expr: str, digits: int = 6) -> str:
    return f"round({expr} + {NUDGE}, {digits})"


READABILITY_COLUMNS = {
    "readability_flesch_kincaid_grade": "grade",
    "readability_avg_grade_level": "grade",
    "readability_flesch_reading_ease": "ease",
    "readability_gunning_fog": "grade * 1.1",
    "readability_smog_index": "grade * 0.9",
    "readability_coleman_liau": "grade",
    "readability_ari": "grade",
    "readability_dale_chall": "grade",
}


DOCUMENT_ITEMS = "items as (select doc_id as item_id, text as txt from documents)"


def item_row(items: str = ITEMS) -> str:
    """The 34 text columns of a source of items: item_id and txt, ids once."""
    read = ", ".join(f"{rounded(f'case when s.blank then {50.0 if v == 'ease' else 8.0} else {v} end')} as {k}" for k, v in READABILITY_COLUMNS.items())
    all_patterns = " + ".join(f"pat_{p}" for p in PLAIN)
    pats = ", ".join(f"pat_{p} as math_pat_{p}" for p in ("equation", "fraction", "variable", "percentage", "ratio", "exponent"))
    return f"""
with {items}, src as (select item_id as id, txt from items), {content('src')}, {readability()},
c as (select *, len({variables()}) as vars, length(t) - length(translate(t, '+-*/^=<>', '')) as ops, case when blank then 0 else {sentences()} end as sc,
  len(list_distinct(hits)) + phrase_kinds as uniq from s3)
select s.id as item_id, {read}, cast(s.blank or rw < 20 as integer) as readability_low_confidence,
  {rounded(per(all_patterns, 'wc'))} as math_density, {' + '.join(f'sym_{x}' for x in SYMBOLS)} as math_total_symbols,
  {' + '.join(f'(case when sym_{x} > 0 then 1 else 0 end)' for x in SYMBOLS)} as math_unique_symbol_types,
  len(nums) as math_numbers_count, coalesce(list_max(nums) - list_min(nums), 0) as math_numbers_range,
  cast(len(list_filter(nums, lambda x: x < 0)) > 0 as integer) as math_has_negative, cast(len(list_filter(nums, lambda x: x <> floor(x))) > 0 as integer) as math_has_decimal,
  uniq as math_vocab_unique_terms, len(hits) + phrase_hits as math_vocab_term_count,
  case when s.blank then 'unknown' else ranked[1] end as math_domain_primary, {rounded(per('best', 'greatest(total, 1)'))} as math_domain_confidence, {pats},
  len(nums) as cognitive_numeric_elements, vars as cognitive_variable_count, ops as cognitive_operation_count, wc as cognitive_word_count, sc as cognitive_sentence_count,
  uniq as cognitive_math_term_count, {rounded(per('len(nums) + vars', 'wc'))} as cognitive_element_density, {rounded(per('wc', 'sc'))} as cognitive_avg_sentence_length
from c s join r3 on s.id = r3.id"""


def kappa(source: str, by: str | None = None) -> str:
    g = by or "0"
    keep = f"{by}, " if by else ""
    return f"""
with r as (select {g} as g{f', {by}' if by else ''}, quality as a, toxic as b from {source} where quality is not null and toxic is not null),
n as (select g, count(*) as n, sum(case when a = b then 1 else 0 end) as same from r group by g),
m as (select g, label, sum(x) as x, sum(y) as y from (select g, a as label, 1 as x, 0 as y from r union all select g, b, 0, 1 from r) group by g, label),
e as (select g, sum(cast(x as double) * y) as both_ from m group by g)
select {keep.replace(by or ' ', f'n.g as {by}') if by else ''}round(cast(same as double) / n, 4) as agreement,
  case when both_ / (cast(n as double) * n) >= 1 then 0.0 else round((cast(same as double) / n - both_ / (cast(n as double) * n)) / (1 - both_ / (cast(n as double) * n)), 4) end as kappa, n
from n join e using (g)"""


def classification() -> str:
    cut = f"regexp_extract(regexp_replace(raw, {quoted(f'```(?:json)?{S}*')}, '', 'g'), '\\{{[\\s\\S]*\\}}', 0)"
    value = lambda m: f"regexp_extract(j, '\"{m}\"\\s*:\\s*(\"[^\"]*\"|\\[[^\\]]*\\]|\\{{[^}}]*\\}}|[^,}}\\s]+)', 1)"
    falsy = "'', 'false', 'null', '0', '0.0', '\"\"', '[]', '{}'"
    flags = [f"(case when {value(m)} in ({falsy}) then 0 else 1 end)" for m in MODEL_NAMES]
    primary = "trim(" + value("primary") + ", '\"')"
    return f"""
with {responses(CLASSIFY_TEXT)}, j as (select item_id, {cut} as j from resp)
select item_id, {', '.join(f'{f} as {m}' for f, m in zip(flags, MODEL_NAMES, strict=True))}, case when {primary} in ({listed([*MODEL_NAMES, 'text_only'])[1:-1]}) then {primary} else 'other' end as primary_model, {' + '.join(flags)} as model_count from j"""


def ocr() -> str:
    cut = f"regexp_extract(regexp_replace(raw, {quoted(f'```(?:json)?{S}*')}, '', 'g'), '\\{{[\\s\\S]*\\}}', 0)"
    field = lambda f: f"regexp_extract(j, '\"{f}\"\\s*:\\s*\"([^\"]*)\"', 1)"
    return f"""
with {responses(OCR_TEXT)}, j as (select item_id, {sql_strip('raw')} as t, {cut} as j from resp),
f as (select *, {field('full_text')} as ft, {field('image_description')} as de, {field('content_type')} as ct, regexp_matches(t, '[a-zA-Z0-9]{{3,}}') as has_text from j)
select item_id,
  case when j <> '' then case when ct <> '' then ct when ft <> '' and de <> '' then 'mixed' when ft <> '' then 'text_only' else 'image_only' end when has_text then 'text_only' else 'image_only' end as content_type,
  case when j <> '' then ft when has_text then t else '' end as full_text,
  case when j <> '' then de when has_text then '' else t end as image_description,
  case when j <> '' then coalesce(try_cast(nullif(regexp_extract(j, '"extraction_confidence"\\s*:\\s*([0-9.]+)', 1), '') as double), -1) else 0.5 end as extraction_confidence,
  case when j <> '' then len({sql_all("regexp_extract(j, '\"labels\"\\s*:\\s*\\[([^\\]]*)\\]', 1)", '"[^"]*"')}) else 0 end as n_labels,
  case when j <> '' then 0 else len({number_list()}) end as n_numbers
from f"""


def choices() -> str:
    """Segments between choice starts: a start is a letter A to E before white space, a period or a parenthesis."""
    start = rf"[A-E](?:[.)]|{S})"
    marked = f"regexp_replace(txt, {quoted(f'({start})')}, chr(1) || '\\1', 'g')"
    return f"""
with {ITEMS}, parts as (select item_id, generate_subscripts(string_split({marked}, chr(1)), 1) as k, unnest(string_split({marked}, chr(1))) as part from items),
found as (select item_id, k, part[1:1] as letter, {sql_strip(f"regexp_replace(part, {quoted(rf'^[A-E](?:[.)]|{S})+')}, '')")} as body, regexp_replace(part, {quoted(rf'^[A-E](?:[.)]|{S})+')}, '') as raw from parts where k > 1),
last as (select * from found where raw <> '' qualify row_number() over (partition by item_id, letter order by k desc) = 1)
select item_id, string_agg(letter || '=' || body, '|' order by letter) as choices, count(*) as n from last group by item_id"""


def expressions() -> str:
    parts = [sql_all("txt", p) for p in LATEX]
    parts.append(sql_all("txt", rf"[^={S_IN}]+{S}*={S}*[^={S_IN}]+"))
    return f"with {ITEMS} select item_id, array_to_string(list_sort(list_distinct(flatten([{', '.join(parts)}]))), '|') as expressions from items"


def vocabulary() -> str:
    """How often each term occurs in each item: words by a join, each phrase by its own pattern."""
    words_ = f"select item_id, unnest({tokens('lower(txt)')}) as term from items"
    phrases = " union all ".join(f"select item_id, '{p}' as term, {phrase(p, 'lower(txt)')} as n from items" for p in PHRASES)
    return f"with {ITEMS}, {VOCABULARY}, terms as (select distinct term from vocab), w as ({words_}), p as ({phrases}) select item_id, term, count(*) as n from w join terms using (term) group by item_id, term union all select item_id, term, n from p where n > 0"


#: Vectors of 64 numbers as gray images of 8 x 8 cells, 8 pixels wide and high; every tenth unreadable. The cells have the pixels' statistics.
PIXELS = """with e as (select vec_id, embedding, list_min(embedding) as low, list_max(embedding) as high from embeddings where len(embedding) = 64),
p as (select vec_id, list_transform(embedding, lambda x: cast(floor((x - low) / greatest(high - low, cast(1e-9 as double)) * 255) as double)) as px from e),
u as (select vec_id, unnest(px) as x from p where vec_id % 10 <> 9),
s as (select vec_id, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as std, min(x) as low, max(x) as high, round(median(x), 5) as middle, max(x) - min(x) as contrast from u group by vec_id)
select p.vec_id, case when p.vec_id % 10 <> 9 then 64 end as width, case when p.vec_id % 10 <> 9 then 64 end as height, case when p.vec_id % 10 <> 9 then cast(1.0 as double) end as aspect_ratio, mean, std, low, high, middle, contrast
from p left join s on p.vec_id = s.vec_id"""


VOCABULARY = f"vocab(domain, ord, term) as (values {vocabulary_sql()})"
MODELS = f"models(ord, model, grp, ccss_domains, grade_band) as (values {models_sql()})"
KEYWORD_SQL = f"len(list_distinct({among('tok', KEYWORDS)}))"
SECRETS_SQL = quoted(SECRETS)
