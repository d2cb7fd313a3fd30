"""Names: datasets, methods, configurations, coverage texts and number formats, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other spellings of method names.
ALIASES = {"spring": "SpringRank", "springrank": "SpringRank", "david": "davidScore", "pagerank": "PageRank", "evc": "eigenvectorCentrality", "svd-rs": "SVD_RS", "svd-nrs": "SVD_NRS"}
#: Families of datasets by the beginning of their name, the first fit counts.
FAMILIES = [("finerBasketball", "Basketball_finer"), ("Basketball", "Basketball_coarse"), ("finerEngland", "Football_finer"), ("England", "Football_coarse"), ("Football", "Football_coarse"), ("Faculty", "Faculty"), ("Dryad", "Animal"), ("Halo", "Halo"), ("finance", "Finance"), ("ERO", "ERO")]


#: How a folder name gives a family, the first fit counts.
TAGS = [
    ("starts", "Basketball_temporal/finer", "basketball_temporal_finer"), ("starts", "Basketball_temporal/", "basketball_temporal"),
    ("starts", "Football_data_England_Premier_League/finer", "football_finer"), ("starts", "Football_data_England_Premier_League/", "football"),
    ("has", "FacultyHiringNetworks", "faculty"), ("is", "Dryad_animal_society", "animal"), ("has", "Halo2BetaData", "headtohead"),
    ("has", "HeadToHead", "headtohead"), ("is", "finance", "finance"),
]
#: Beginning of a short name in lower case, folder, F, K.
SHORT_NAMES = [
    ("basketball", "Basketball_temporal/{season}", 70, 20), ("finer_basketball", "Basketball_temporal/finer{season}", 2, 20),
    ("animal", "Dryad_animal_society/", 3, 3), ("finance", "finance/", 5, 20), ("headtohead", "Halo2BetaData/HeadToHead", 39, 48),
    ("faculty_business", "FacultyHiringNetworks/Business/Business_FM_Full_", 6, 5), ("faculty_cs", "FacultyHiringNetworks/ComputerScience/ComputerScience_FM_Full_", 8, 9),
    ("faculty_history", "FacultyHiringNetworks/History/History_FM_Full_", 22, 12), ("football", "Football_data_England_Premier_League/England_{season}_{next}", 19, 9),
    ("finer_football", "Football_data_England_Premier_League/finerEngland_{season}_{next}", 4, 9),
]


def family(dataset: Column) -> Column:
    out = F.lit("other")
    for start, name in reversed(FAMILIES):
        out = F.when(dataset.startswith(start), name).otherwise(out)
    return out


def family_prefix(dataset: Column) -> Column:
    """What stands before the first slash."""
    return F.split_part(dataset, F.lit("/"), F.lit(1))


def method_family(method: Column) -> Column:
    return F.when(method.startswith("MFAS"), "ours").when(method.isin("DIGRAC", "ib") | method.startswith("DIGRAC") | method.startswith("ib_"), "gnn").otherwise("classical")


def canonical_method(method: Column) -> Column:
    """Trimmed, and an alias replaced; unknown names pass."""
    name = F.trim(method)
    table = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, name), name)


def is_combo(method: Column, longest: int = 40) -> Column:
    """Several methods in one name, or a name that is too long for one; a null isn't."""
    return F.coalesce(method.contains("+") | method.contains(",") | (F.length(method) > longest), F.lit(False))


def config_key(trials: Column, train: Column, test: Column, seed: Column | None = None) -> Column:
    parts = [F.lit("trials"), trials.cast("string"), F.lit("train_r"), train.cast("string"), F.lit("test_r"), test.cast("string")]
    return F.concat(*parts, *([F.lit("seed"), seed.cast("string")] if seed is not None else []))


def config_trials(config: Column) -> Column:
    return F.regexp_extract(config, r"trials(\d+)", 1).try_cast("int")


def short_config(config: Column, size: int = 20) -> Column:
    return F.when(F.length(config) > size, F.concat(F.substring(config, 1, size), F.lit("..."))).otherwise(config)


def coverage_parts(text: Column) -> tuple[Column, Column]:
    """The two numbers of "n / N"."""
    return tuple(F.trim(F.split_part(text, F.lit("/"), F.lit(i))).try_cast("int") for i in (1, 2))


def seasons(first: int | Column = 1985, last: int | Column = 2014, prefix: str = "Basketball_temporal/") -> Column:
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda y: F.concat(F.lit(prefix), y.cast("string")))


def latex(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("_"), F.lit("\\_")), F.lit("&"), F.lit("\\&"))


def mean_std(mean: Column, std: Column, digits: int = 2) -> Column:
    return F.when(mean.isNull(), "nan$\\pm$nan").otherwise(F.format_string(f"%.{digits}f$\\pm$%.{digits}f", mean, std))


def number(value: Column, digits: int = 4) -> Column:
    return F.when(value.isNull(), "---").otherwise(F.format_string(f"%.{digits}f", value))


def bin_name(value: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first cut that isn't exceeded; null falls to ``rest``."""
    out = F.lit(rest)
    for cut, label in reversed(cuts):
        out = F.when(value <= cut, label).otherwise(out)
    return out


def safe_inverse_root(d: Column) -> Column:
    return 1 / F.greatest(F.sqrt(d), F.lit(1 / 999999999))


def density(n: Column, m: Column) -> Column:
    return F.try_divide(m.cast("double"), n.cast("double") * (n - 1))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def safe_cast(text: Column) -> Column:
    """Empty, NA and nan texts are null."""
    t = F.trim(text)
    return F.when(F.lower(t).isin("", "na", "nan", "none", "null"), None).otherwise(t.try_cast("double"))


def polar(re: Column, im: Column) -> tuple[Column, Column]:
    """Length and angle of a complex number."""
    return F.hypot(re, im), F.atan2(im, re)


def verdict(favourable: Column, n: Column, crosses: Column, least: int = 20) -> Column:
    """Labels are fixed values: a favourable result of enough cases that holds at the other thresholds too, that doesn't, or neither."""
    return F.when(favourable & (n >= least), F.when(crosses, "strong and robust").otherwise("promising but narrow")).otherwise("too unstable to emphasize")


def family_tag(dataset: Column) -> Column:
    """The third family scheme, by folder names."""
    out = F.lit("other")
    for kind, text, name in reversed(TAGS):
        fits = dataset == text if kind == "is" else dataset.contains(text) if kind == "has" else dataset.startswith(text)
        out = F.when(fits, name).otherwise(out)
    return out


def expanded(name: Column, season: Column) -> tuple[Column, Column, Column]:
    """Folder, F (features) and K (clusters) of a short data set name; the name itself and nulls if it is unknown."""
    low = F.lower(name)
    folder, f, k = name, F.lit(None).cast("int"), F.lit(None).cast("int")
    for start, form, features, clusters in reversed(SHORT_NAMES):
        parts = []
        for piece in re.split(r"(\{season\}|\{next\})", form):
            if piece:
                parts.append(season.cast("string") if piece == "{season}" else (season + 1).cast("string") if piece == "{next}" else F.lit(piece))
        fits = low.startswith(start)
        folder, f, k = F.when(fits, F.concat(*parts)).otherwise(folder), F.when(fits, features).otherwise(f), F.when(fits, clusters).otherwise(k)
    return folder, f, k


def status(rows: Column, blocked: Column, note: Column, modes: Column) -> Column:
    """Of an ablation table: missing without rows, blocked with the first row's note, else the sorted modes."""
    return F.when(rows == 0, "missing").when(blocked, F.concat(F.lit("blocked: "), F.trim(note))).otherwise(F.concat(F.lit("ok: "), F.array_join(F.array_sort(modes), ", ")))
