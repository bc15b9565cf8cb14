"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Of each text, these units are compared with the templates (public identifiers, titles, statements, headers and whole short
licences): every line that holds a cue word; every block, a run of lines without a blank one, that holds a cue word, such as a
header comment or a paragraph; and all such blocks of the text together, which is what a licence file comes down to.
Units are compared once for each distinct one: its words and the templates' words form sparse vectors of term frequency
times inverse document frequency (over the templates), kept as integers so that sums are exact. A file's licence is that
of its best unit at MIN_COSINE or more; a bare copyright line (FALLBACK) counts only where there is no other.
A licence file (by its name, or by a line that closes it) also licenses its directory. A file without a licence of its own
takes that of its nearest ancestor directory; paths are joined a distinct directory at a time.

Texts are read once; units go by a digest from there on. What is broadcast is the templates' tables, fixed in size.

Native: DataFrame expressions only.

Defined results: null or empty texts have no licence of their own; lines end at \\n only, lines and blocks of any length are
compared whole; of equal cosines the licence first in the alphabet wins, then the earlier line; a directory with several licence
files takes the best, then the first in the alphabet; rows of one id share the licence found in any of them; rows with a null id or
path have none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .licence_texts import templates as public_templates

MIN_COSINE = 0.7
SCALE = 1000
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|public domain|permission (?:is|to)|redistribution|warrant(?:y|ies)|creative commons|cc0"
#: What lies between blocks: lines of white space.
BLANK = r"\n[ \t-\r]*\n"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TEMPLATES = public_templates()
#: What a copyright line says by itself. It stands in the notices of other licences too, so it counts only where no other template is near enough.
FALLBACK = "Proprietary"


def term_weights(templates: list[tuple[str, str]]) -> tuple[dict[str, int], int, list[tuple[int, str, dict[str, int]]]]:
    """Each known term's weight, an unknown term's, and each template's number, licence and vector."""
    bags = [re.findall("[a-z0-9]+", text.lower()) for _, text in templates]
    idf = lambda df: round(SCALE * (1 + math.log((1 + len(bags)) / (1 + df))))
    weights = {t: idf(sum(t in b for b in bags)) for t in sorted({t for b in bags for t in b})}
    vectors = [(k, licence, {t: b.count(t) * weights[t] for t in b}) for k, ((licence, _), b) in enumerate(zip(templates, bags, strict=True))]
    return weights, idf(0), vectors


def unit_licences(units: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = MIN_COSINE) -> DataFrame:
    """key, licence, cosine: for each distinct unit that is near enough to a template. units: key (a digest) and unit."""
    weights, unknown, vectors = term_weights(templates)
    table = lambda rows, columns: units.sparkSession.sql(f"select * from values {', '.join(map(str, rows))} as t({columns})")
    terms = table(weights.items(), "term, idf")
    parts = table([(t, k, w) for k, _, v in vectors for t, w in v.items()], "term, k, tw")
    norms = table([(k, licence, sum(w * w for w in v.values())) for k, licence, v in vectors], "k, licence, tnorm")
    words = F.regexp_extract_all(F.translate("unit", _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0))
    counts = units.dropDuplicates(["key"]).select("key", F.explode(words).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counts.join(F.broadcast(terms), "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).cast("decimal(38,0)").alias("w"))
    norm = weighted.groupBy("key").agg(F.sum(F.col("w") * F.col("w")).cast("double").alias("norm"))
    dot = weighted.join(F.broadcast(parts), "term").groupBy("key", "k").agg(F.sum(F.col("w") * F.col("tw")).cast("double").alias("dot"))
    cosine = F.col("dot") / F.sqrt(F.col("norm") * F.col("tnorm").cast("double"))
    scored = dot.join(norm, "key").join(F.broadcast(norms), "k").select("key", "licence", cosine.alias("cosine")).where(F.col("cosine") >= least)
    best = scored.groupBy("key").agg(F.min(F.struct((F.col("licence") == FALLBACK).alias("fallback"), (-F.col("cosine")).alias("minus"), "licence")).alias("best"))
    return best.select("key", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("cosine"))


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(?:(.*)/)?[^/]*$", 1)


def scan(files: DataFrame, *, closing_line_governs: bool = False, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """file_id, path, licence, cosine, origin (own, inherited or null), from_directory.

    files: file_id, path, text. Licence files go by their names; closing_line_governs: those whose last line that
    isn't blank states a licence count too. Cosines are exact up to the rounding of their last operation.
    """
    files = files.select(F.col("file_id").cast("long").alias("file_id"), "path", "text")
    cued = files.where(F.col("text").rlike(CUE) & F.col("file_id").isNotNull() & F.col("path").isNotNull())
    last = F.size(F.split(F.regexp_replace("text", r"[ \t-\r]+$", ""), "\n", -1)) - 1
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, at: F.struct(at.alias("at"), x.alias("unit"))), lambda x: x["unit"].rlike(CUE))
    cued_blocks = F.filter(F.split("text", BLANK, -1), lambda x: x.rlike(CUE))
    whole = F.when(F.size("blocks") > 1, F.array(F.array_join("blocks", "\n"))).otherwise(F.array())
    others = F.transform(F.concat("blocks", whole), lambda x: F.struct(F.lit(-1).alias("at"), x.alias("unit")))
    units = cued.select("file_id", "path", last.alias("last"), lines.alias("lines"), cued_blocks.alias("blocks"))
    units = units.select("file_id", "path", "last", F.explode(F.concat("lines", others)).alias("u")).select("file_id", "path", "last", "u.at", F.md5("u.unit").alias("key"), "u.unit")
    units = materialize(units)
    found = materialize(units.drop("unit").join(unit_licences(units.select("key", "unit"), templates), "key"))
    governs = F.col("path").rlike(FILE_NAME)
    if closing_line_governs:
        governs = governs | (F.col("at") == F.col("last"))
    fallback = (F.col("licence") == FALLBACK).alias("fallback")
    own = found.groupBy("file_id").agg(F.min(F.struct(fallback, (-F.col("cosine")).alias("minus"), "licence", "at")).alias("own"))
    own = own.select("file_id", F.col("own.licence").alias("own_licence"), (-F.col("own.minus")).alias("own_cosine"))
    of_directory = found.where(governs).groupBy(directory_of(F.col("path")).alias("from_directory")).agg(F.min(F.struct(fallback, (-F.col("cosine")).alias("minus"), "licence")).alias("d"))
    of_directory = of_directory.select("from_directory", F.col("d.licence").alias("dir_licence"), (-F.col("d.minus")).alias("dir_cosine"))
    directories = files.where("path is not null").select(directory_of(F.col("path")).alias("directory")).distinct()
    steps = F.split("directory", "/", -1)
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("from_directory")))
    up = directories.select("directory", F.explode(ancestors).alias("up")).select("directory", "up.depth", "up.from_directory")
    nearest = up.join(of_directory, "from_directory").groupBy("directory").agg(F.max(F.struct("depth", "from_directory", "dir_licence", "dir_cosine")).alias("n"))
    nearest = nearest.select("directory", "n.from_directory", "n.dir_licence", "n.dir_cosine")
    narrow = files.select("file_id", "path", directory_of(F.col("path")).alias("directory"))
    joined = narrow.join(own, "file_id", "left").join(nearest, "directory", "left")
    inherits = F.col("own_licence").isNull() & F.col("dir_licence").isNotNull()
    return joined.select(
        "file_id",
        "path",
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.round(F.coalesce("own_cosine", "dir_cosine"), 4).alias("cosine"),
        F.when(F.col("own_licence").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("from_directory")).alias("from_directory"),
    )


#: The table has no paths: source, language and a block of ids stand for directories. A closing statement governs its block.
IDS_EACH = 64


def op3(documents: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(doc_id / IDS_EACH).cast("string"), F.concat(doc_id.cast("string"), F.lit(".txt")))
    files = documents.select(doc_id.alias("file_id"), F.when(doc_id.isNotNull(), path).alias("path"), "text")
    return scan(files, closing_line_governs=True).withColumnRenamed("file_id", "doc_id")


def op3_sql() -> str:
    weights, unknown, vectors = term_weights(TEMPLATES)
    row = lambda *x: "(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in x) + ")"
    terms = ", ".join(row(t, w) for t, w in weights.items())
    parts = ", ".join(row(t, k, w) for k, _, v in vectors for t, w in v.items())
    norms = ", ".join(row(k, licence, sum(w * w for w in v.values())) for k, licence, v in vectors)
    cue = CUE.replace("(?i)", "")
    return f"""
with terms(term, idf) as (values {terms}), parts(term, k, tw) as (values {parts}), norms(k, licence, tnorm) as (values {norms}),
files as (select doc_id, text, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || cast(floor(doc_id / {IDS_EACH}) as bigint) as directory from documents),
named as (select *, directory || '/' || doc_id || '.txt' as path from files),
cued as (select *, len(string_split(regexp_replace(text, '[ \\t-\\r]+$', ''), chr(10))) as last_line from named where regexp_matches(text, '{cue}', 'i')),
blocks as (select *, list_filter(string_split_regex(text, '\\n[ \\t-\\r]*\\n'), lambda x: regexp_matches(x, '{cue}', 'i')) as blocks from cued),
units as (
  select doc_id, directory, last_line, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as line from cued
  union all select doc_id, directory, last_line, 0, unnest(blocks) from blocks
  union all select doc_id, directory, last_line, 0, array_to_string(blocks, chr(10)) from blocks where len(blocks) > 1),
picked as (select * from units where regexp_matches(line, '{cue}', 'i')),
counts as (
  select line, term, count(*) as tf
  from (select line, unnest(regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+')) as term from (select distinct line from picked)) group by line, term),
weighted as (select line, term, tf * coalesce(idf, {unknown}) as w from counts left join terms using (term)),
norm as (select line, sum(w * w) as norm from weighted group by line),
dot as (select line, k, sum(w * tw) as dot from weighted join parts using (term) group by line, k),
scored as (select line, licence, cast(dot as double) / sqrt(cast(norm as double) * cast(tnorm as double)) as cosine from dot join norm using (line) join norms using (k)),
best as (select line, licence, cosine from scored where cosine >= {MIN_COSINE} qualify row_number() over (partition by line order by licence = '{FALLBACK}', cosine desc, licence) = 1),
found as (select * from picked join best using (line)),
own as (select doc_id, licence, cosine from found qualify row_number() over (partition by doc_id order by licence = '{FALLBACK}', cosine desc, licence, line_no) = 1),
dirs as (select directory as from_directory, licence, cosine from found where line_no = last_line qualify row_number() over (partition by directory order by licence = '{FALLBACK}', cosine desc, licence) = 1),
up as (
  select directory, k as depth, array_to_string(string_split(directory, '/')[1:k], '/') as from_directory
  from (select directory, unnest(range(0, len(string_split(directory, '/')) + 1)) as k from (select distinct directory from files))),
nearest as (select up.directory, dirs.* from up join dirs using (from_directory) qualify row_number() over (partition by up.directory order by depth desc) = 1)
select n.doc_id, n.path, coalesce(o.licence, a.licence) as licence, round(coalesce(o.cosine, a.cosine), 4) as cosine,
       case when o.licence is not null then 'own' when a.licence is not null then 'inherited' end as origin,
       case when o.licence is null then a.from_directory end as from_directory
from named n left join own o on n.doc_id = o.doc_id left join nearest a on n.directory = a.directory"""
