"""Run files of a coarse-grained model: topology, interaction ranges, tables and density parameters, and their writers.

These files are small (they describe types and molecules, not frames) and are parsed on the driver into relations.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from ..config import MODES


@dataclasses.dataclass
class Molecule:
    sites: list[str]
    bonds: list[tuple[int, int]]
    angles: list[tuple[int, int, int]] | None = None
    dihedrals: list[tuple[int, int, int, int]] | None = None
    style: int = 3


@dataclasses.dataclass
class Topology:
    n_sites: int
    types: list[str]
    molecules: list[Molecule]
    system: list[tuple[int, int]]
    threebody: list[tuple[str, str, str, float, float]]
    groups: dict[str, list[str]]
    weights: list[tuple[str, str, float]]


def type_id(word: str, types: list[str]) -> int:
    """Number of a type given by name or number, from 1."""
    if word in types:
        return types.index(word) + 1
    if word.isdigit() and 1 <= int(word) <= len(types):
        return int(word)
    raise ValueError(f"unknown type {word!r}")


def parse_topology(text: str) -> Topology:
    """A topology from its keyword sections. Site numbers in molecules count from 1; explicit angles have the centre first
    unless their section's format is 1 (ends around the centre); dihedrals have the central bond first, or with format 1 in chain order."""
    words = [w for line in text.splitlines() for w in line.split("#")[0].split()]
    at = 0

    def take(n: int = 1) -> list[str]:
        nonlocal at
        if at + n > len(words):
            raise ValueError("topology ends early")
        got = words[at : at + n]
        at += n
        return got

    def named(key: str) -> int:
        word, n = take(2)
        if word != key:
            raise ValueError(f"expected {key!r}, found {word!r}")
        return int(n)

    n_sites, n_types = named("cgsites"), named("cgtypes")
    types = take(n_types)
    top = Topology(n_sites, types, [], [], [], {}, [])
    while at < len(words):
        key = take()[0]
        if key == "threebody":
            for _ in range(int(take()[0])):
                i, j, k, cos0, cutoff = take(5)
                top.threebody.append((i, j, k, float(cos0), float(cutoff)))
        elif key == "density_nonbonded":
            for _ in range(int(take()[0])):
                name, n = take(2)
                top.groups[name] = take(int(n))
        elif key == "density_weights":
            for _ in range(int(take()[0])):
                group, kind, weight = take(3)
                top.weights.append((group, kind, float(weight)))
        elif key == "moltypes":
            for _ in range(int(take()[0])):
                word, n, style = take(3)
                if word != "mol":
                    raise ValueError(f"expected 'mol', found {word!r}")
                if take()[0] != "sitetypes":
                    raise ValueError("expected 'sitetypes'")
                mol = Molecule(take(int(n)), [], style=int(style))
                mol.bonds = [tuple(map(int, take(2))) for _ in range(named("bonds"))]
                if mol.style == -1:
                    count = named("angles")
                    order = int(take()[0]) if count and _has_format(words, at, count, 3, "dihedrals") else 0
                    listed = [tuple(map(int, take(3))) for _ in range(count)]
                    mol.angles = [(a, b, c) if order else (b, a, c) for a, b, c in listed]
                    count = named("dihedrals")
                    order = int(take()[0]) if count and _has_format(words, at, count, 4, None) else 0
                    listed = [tuple(map(int, take(4))) for _ in range(count)]
                    mol.dihedrals = [(a, b, c, d) if order else (c, a, b, d) for a, b, c, d in listed]
                top.molecules.append(mol)
        elif key == "system":
            for _ in range(int(take()[0])):
                kind, count = take(2)
                top.system.append((int(kind), int(count)))
        else:
            raise ValueError(f"unknown topology section {key!r}")
    total = sum(len(top.molecules[k - 1].sites) * n for k, n in top.system)
    if total != n_sites:
        raise ValueError(f"the system has {total} sites, cgsites says {n_sites}")
    return top


def _has_format(words: list[str], at: int, count: int, width: int, nxt: str | None) -> bool:
    """Whether a format number stands before `count` rows of `width` numbers: the word after the rows tells."""
    after = at + count * width
    return after < len(words) and words[after].lstrip("-").isdigit() and (nxt is None or (after + 1 < len(words) and words[after + 1] == nxt))


def topology_frames(spark: SparkSession, top: Topology) -> dict[str, DataFrame]:
    """sites(site_id, type_id, mol_id), bonds(i, j), and explicit angles(k, j, l) and dihedrals(k, i, j, l), from 0, replicated.

    Only the templates are made on the driver; copies come from a sequence.
    """
    from pyspark.sql import functions as F

    from ..operators.topology import replicate

    out: dict[str, DataFrame] = {}

    def add(name: str, df: DataFrame) -> None:
        out[name] = df if name not in out else out[name].union(df)

    start = first_mol = 0
    for kind, n in top.system:
        mol = top.molecules[kind - 1]
        size = len(mol.sites)
        sites = spark.createDataFrame([(i, type_id(t, top.types)) for i, t in enumerate(mol.sites)], "site_id long, type_id int")
        copies = sites.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        add("sites", copies.select((F.col("site_id") + start + F.col("copy") * size).alias("site_id"), "type_id", (F.col("copy") + first_mol).alias("mol_id")))
        for name, rows, schema in (("bonds", mol.bonds, "i j"), ("angles", mol.angles or [], "k j l"), ("dihedrals", mol.dihedrals or [], "k i j l")):
            cols = schema.split()
            listed = spark.createDataFrame([tuple(int(x) - 1 for x in r) for r in rows], ", ".join(f"{c} long" for c in cols))
            add(name, replicate(listed, n, size, tuple(cols), start))
        start += size * n
        first_mol += n
    return out


def parse_ranges(text: str, types: list[str], n_types: int, parameters: int = 0) -> list[dict]:
    """Rows `t1 .. tn lo hi mode [p..]` of a range file, types by name or number."""
    out = []
    for line in text.splitlines():
        w = line.split("#")[0].split()
        if not w:
            continue
        if len(w) < n_types + 3 + parameters:
            raise ValueError(f"range line too short: {line!r}")
        mode = w[n_types + 2]
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        lo, hi = float(w[n_types]), float(w[n_types + 1])
        if mode != "none" and hi < lo:
            raise ValueError(f"range ends before it starts: {line!r}")
        names = w[:n_types]
        out.append({"types": [type_id(t, types) if t in types or t.isdigit() else t for t in names], "lo": lo, "hi": hi, "mode": mode, "p": [float(x) for x in w[n_types + 3 : n_types + 3 + parameters]]})
    return out


def parse_tables(text: str, types: list[str]) -> list[dict]:
    """Tabulated interactions: class headers `name n binwidth`; tables of types, `lo hi`, and a value a line.

    Several lines of types before a range share one table.
    """
    lines = [ln.split() for ln in text.splitlines() if ln.split()]
    at, out = 0, []
    arity = {"nonbonded": 2, "pair": 2, "bond": 2, "angle": 3, "dihedral": 4, "density": 2}
    while at < len(lines):
        kind, n, width = lines[at][0], int(lines[at][1]), float(lines[at][2])
        at += 1
        made = 0
        while made < n:
            keys = []
            while len(lines[at]) == arity[kind] and not (arity[kind] == 2 and keys and _is_range(lines, at, width)):
                keys.append([type_id(t, types) for t in lines[at]])
                at += 1
            lo, hi = float(lines[at][0]), float(lines[at][1])
            at += 1
            count = int((hi - lo) / width + 0.5) + 1
            values = [float(lines[at + k][0]) for k in range(count)]
            at += count
            out += [{"class": kind, "types": k, "lo": lo, "hi": hi, "binwidth": width, "values": values} for k in keys]
            made += len(keys)
    return out


def _is_range(lines: list[list[str]], at: int, width: float) -> bool:
    """Whether a two-word line is a table's range: values, one a line, follow it."""
    return at + 1 < len(lines) and len(lines[at + 1]) == 1


def table_rows(spark: SparkSession, tables: list[dict]) -> DataFrame:
    return spark.createDataFrame([(t["class"], t["types"], t["lo"], t["hi"], t["binwidth"], k, v) for t in tables for k, v in enumerate(t["values"])], "class string, types array<int>, lo double, hi double, binwidth double, idx int, v double")


def parse_density_parameters(text: str, groups: list[str], style: int) -> list[tuple[str, str, float, float]]:
    """(home, other, sigma, switch) for every ordered pair of groups."""
    out = []
    for line in text.splitlines():
        w = line.split()
        if w:
            out.append((w[0], w[1], float(w[2]), float(w[3]) if style == 2 else 0.0))
    if len(out) != len(groups) ** 2:
        raise ValueError(f"{len(out)} density parameters for {len(groups)} groups")
    return out


def parse_lambda(text: str) -> list[float]:
    """Regularization parameters: one a line, or a batch header `n mode` and n values."""
    words = text.split()
    first = text.split("\n", 1)[0].split()
    return [float(w) for w in (words[2 : 2 + int(first[0])] if len(first) == 2 and first[0].isdigit() else words)]


def range_lines(ranges: DataFrame, by: list[str]) -> DataFrame:
    """(line): a range file's rows, `types lo hi mode`."""
    from pyspark.sql import functions as F

    return ranges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in by], F.format_string("%.6f", "lo"), F.format_string("%.6f", "hi"), F.col("mode")).alias("line"))


def value_lines(table: DataFrame, axis: str, value: str) -> DataFrame:
    """(line): `axis value` rows in axis order."""
    from pyspark.sql import functions as F

    return table.orderBy(axis).select(F.format_string("%.6f %.6f", F.col(axis), F.col(value)).alias("line"))


def save_equations(triangle: DataFrame, path: str, run: str, inverse_norm: float) -> None:
    """Normal equations of a run as Parquet (run, n, i, j, v), to be merged with those of others."""
    from pyspark.sql import functions as F

    triangle.select(F.lit(run).alias("run"), F.lit(float(inverse_norm)).alias("n"), "i", "j", "v").write.mode("overwrite").parquet(path)
