"""Fixed vocabularies: mathematical domains and terms, keywords, symbols, visual models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Domains in the order in which ties go, with their terms.
DOMAINS: dict[str, list[str]] = {
    "arithmetic": ["add", "subtract", "multiply", "divide", "sum", "difference", "product", "quotient", "remainder", "factor", "multiple", "even", "odd", "prime", "composite", "digit", "place value"],
    "algebra": ["variable", "coefficient", "term", "expression", "equation", "inequality", "solve", "simplify", "factor", "polynomial", "linear", "quadratic", "function", "slope", "intercept"],
    "geometry": ["point", "line", "ray", "segment", "angle", "triangle", "rectangle", "square", "circle", "polygon", "area", "perimeter", "volume", "parallel", "perpendicular", "congruent"],
    "statistics": ["mean", "median", "mode", "range", "data", "graph", "chart", "probability", "outcome", "sample", "population", "distribution", "standard deviation", "variance", "correlation"],
    "calculus": ["limit", "derivative", "integral", "differentiate", "integrate", "continuous", "rate of change", "maximum", "minimum", "optimization", "series", "convergence"],
    "fractions": ["fraction", "numerator", "denominator", "mixed number", "improper", "equivalent", "simplify", "common denominator", "decimal", "percent", "ratio", "proportion"],
}

# Keywords of the cognitive-load fallback.
KEYWORDS = ["add", "subtract", "multiply", "divide", "sum", "difference", "product", "quotient", "fraction", "decimal", "percent", "equation", "variable", "solve", "function", "graph", "area", "perimeter", "volume", "angle", "triangle", "circle", "mean", "median", "mode", "probability", "ratio", "proportion"]

# Symbol names and the characters that count for each.
SYMBOLS: dict[str, str] = {
    "addition": "+",
    "subtraction": "-",
    "multiplication": "×*·",
    "division": "÷/",
    "equals": "=",
    "less_than": "<",
    "greater_than": ">",
    "less_equal": "≤",
    "greater_equal": "≥",
    "not_equal": "≠",
    "approximately": "≈",
    "square_root": "√",
    "summation": "∑",
    "integral": "∫",
    "pi": "π",
    "infinity": "∞",
}

# Visual models in their order, with group, CCSS domains and grade band.
VISUAL_MODELS: list[tuple[str, str, str, str]] = [
    ("number_line", "number_quantity", "NBT, NF, NS, G, EE, F", "K-12"),
    ("coordinate_plane", "number_quantity", "G, EE, F", "5-12"),
    ("bar_graph", "data_display", "MD (K-5), SP (6-8)", "K-8"),
    ("line_graph", "data_display", "MD (K-5), SP (6-8)", "4-8"),
    ("pictograph", "data_display", "MD", "K-3"),
    ("dot_plot", "data_display", "MD (K-5), SP (6-8)", "3-8"),
    ("histogram", "data_display", "SP", "6-8"),
    ("circle_graph", "data_display", "SP", "6-8"),
    ("scatter_plot", "data_display", "SP", "8-12"),
    ("table", "organizational", "All domains", "K-12"),
    ("geometric_figure", "geometric", "G", "K-12"),
    ("solid_figure", "geometric", "G", "K-8"),
    ("area_model", "part_whole_model", "OA, NF, NBT", "K-5"),
    ("array", "part_whole_model", "OA, NBT", "K-3"),
    ("tape_diagram", "part_whole_model", "OA, NF", "K-7"),
    ("fraction_model", "part_whole_model", "NF", "3-5"),
    ("pattern_visual", "other_visual", "OA", "K-5"),
    ("tree_diagram", "organizational", "SP, OA", "6-8"),
    ("picture", "other_visual", "Various", "K-12"),
    ("other", "other_visual", "Various", "K-12"),
]
MODEL_NAMES = [m[0] for m in VISUAL_MODELS]

TERMS = sorted({t for terms in DOMAINS.values() for t in terms})
SINGLE_TERMS = [t for t in TERMS if " " not in t]
PHRASES = [t for t in TERMS if " " in t]


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


def vocabulary_sql() -> str:
    """Rows of domain, ord, term for a VALUES clause of either engine."""
    return _rows([(d, k, t) for k, (d, terms) in enumerate(DOMAINS.items()) for t in terms])


def models_sql() -> str:
    return _rows([(k, *m) for k, m in enumerate(VISUAL_MODELS)])


def domain_vocabulary(spark: SparkSession) -> DataFrame:
    """domain, ord, term: 87 rows."""
    return spark.sql(f"select * from values {vocabulary_sql()} as t(domain, ord, term)")


def visual_model_dim(spark: SparkSession) -> DataFrame:
    """ord, model, grp, ccss_domains, grade_band: 20 rows."""
    return spark.sql(f"select * from values {models_sql()} as t(ord, model, grp, ccss_domains, grade_band)")
