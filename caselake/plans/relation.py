"""Operators as SQL over named inputs: each is DataFrame -> DataFrame, and the same text serves the DuckDB check.

``{name}`` in the text is an input. Two engines differ in a few function names; those are written ``@name(...)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from caselake.operators.graph import written

#: Name -> its form in Spark and in DuckDB, with {} for the arguments.
FORMS: dict[str, tuple[str, str]] = {
    "pctl": ("percentile({})", "quantile_cont({})"),
    "rint": ("rint({})", "round_even({}, 0)"),
    # Spark rounds a double as it prints: 3534.9449999999997, what doubles make of 3534.945, goes down.
    "round2": ("(round(({}) * 1e2) / 1e2)", "round({}, 2)"),
    "round10": ("(round(({}) * 1e10) / 1e10)", "round({}, 10)"),
    "u": ("(CAST(conv(substring(md5({}), 1, 13), 16, 10) AS DOUBLE) / 4503599627370496)", "(CAST(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"),
    # DuckDB's order has nulls last, Spark's first.
    "last": ("{} NULLS LAST", "{}"),
    "gap": ("timestampdiff(MICROSECOND, {})", "date_diff('microsecond', {})"),
    "hour": ("date_format({}, 'yyyy-MM-dd HH')", "strftime({}, '%Y-%m-%d %H')"),
    "json_k": ("CAST(get_json_object({}, '$.k') AS BIGINT)", "CAST(json_extract_string({}, '$.k') AS BIGINT)"),
    "double": ("try_cast({} AS DOUBLE)", "TRY_CAST({} AS DOUBLE)"),
    "series": ("explode(sequence({}))", "unnest(generate_series({}))"),
    "fold": ("trim(regexp_replace(lower(translate({}, 'áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÉÊÍÓÔÕÚÇ', 'aaaaaeeeeiiiiooooouuuucnaaaaeeiooouc')), '\\\\s+', ' '))", "trim(regexp_replace(lower(translate({}, 'áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÉÊÍÓÔÕÚÇ', 'aaaaaeeeeiiiiooooouuuucnaaaaeeiooouc')), '\\s+', ' ', 'g'))"),
    "pair": ("struct({})", "row({})"),
    "fail": ("CAST(raise_error({}) AS BOOLEAN)", "CAST(error({}) AS BOOLEAN)"),
    "word": ("CAST(conv(substring({}, 12), 16, 10) AS DECIMAL(38, 0))", "CAST(CAST('0x' || substr({}, 12) AS BIGINT) AS HUGEINT)"),
    "joined": ("array_join(array_sort(collect_list({})), '|')", "string_agg({0}, '|' ORDER BY {0})"),
    "sha256": ("sha2({}, 256)", "sha256({})"),
    "replace_all": ("regexp_replace({})", "regexp_replace({}, 'g')"),
}


def _forms(text: str, engine: int) -> str:
    while m := re.search(r"@(\w+)\(", text):
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        inner = text[m.end() : at - 1]
        form = FORMS[m[1]][engine]
        text = text[: m.start()] + (form.replace("{0}", inner) if "{0}" in form else form.replace("{}", inner)) + text[at:]
    return text


def _files(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of each file under ``path``, as the store lists them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in listed))


class Relations:
    """A set of named relations; ``add`` defines one, its inputs are the ``{names}`` in its text."""

    def __init__(self) -> None:
        self.text: dict[str, str] = {}
        self.made_by: dict[str, Callable[..., DataFrame]] = {}
        self.whole: dict[str, tuple[str, ...]] = {}
        self.shared: set[str] = set()
        self._written: dict[tuple, DataFrame] = {}

    def add(self, name: str, sql: str, frames: Callable[..., DataFrame] | None = None) -> None:
        """``frames``: makes it from its inputs' DataFrames where Spark's SQL alone can't; the text then serves the check."""
        self.text[name] = sql.strip()
        if frames is not None:
            self.made_by[name] = frames

    def at_once(self, name: str, needs: tuple[str, ...], frames: Callable[..., DataFrame]) -> None:
        """Over tables, make ``name`` from ``needs`` by ``frames`` and not relation by relation; ``over`` and ``operator`` keep to its text."""
        self.whole[name], self.made_by[name] = needs, frames

    def inputs(self, name: str) -> list[str]:
        return list(dict.fromkeys(re.findall(r"\{(\w+)\}", self.text[name])))

    def operator(self, name: str) -> Callable[..., DataFrame]:
        """The relation as a function of its inputs, given as keyword arguments."""

        def run(**inputs: DataFrame) -> DataFrame:
            spark = next(iter(inputs.values())).sparkSession
            if name in self.made_by and name not in self.whole:
                return self.made_by[name](**inputs)
            return spark.sql(_forms(self.text[name], 0), **inputs)

        run.__name__, run.__doc__ = name, f"Inputs: {', '.join(self.inputs(name))}."
        return run

    def share(self, *names: str) -> None:
        """Relations that are written to the shared folder once for an input, and read from there by all that build on them."""
        self.shared |= set(names)

    def tables(self, name: str) -> set[str]:
        """The tables that a relation is made from."""
        return {name} if name not in self.text else set().union(*(self.tables(i) for i in self.inputs(name)))

    def frame(self, spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
        """The relation over the tables in ``sf_dir``."""
        made = {} if made is None else made
        if name not in made:
            made[name] = self._kept(spark, sf_dir, name, made) if name in self.shared else self._made(spark, sf_dir, name, made)
        return made[name]

    def over(self, spark: SparkSession, **given: DataFrame) -> Callable[[str], DataFrame]:
        """A function from a name to that relation over the given relations and tables; shared relations are written once for it."""
        made = dict(given)

        def of(name: str) -> DataFrame:
            if name not in made:
                if name not in self.text:
                    raise KeyError(f"no input {name} is given")
                got = {i: of(i) for i in self.inputs(name)}
                df = self.made_by[name](**got) if name in self.made_by and name not in self.whole else spark.sql(_forms(self.text[name], 0), **got)
                made[name] = written(df) if name in self.shared else df
            return made[name]

        return of

    def _made(self, spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame]) -> DataFrame:
        if name not in self.text:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")
        got = {i: self.frame(spark, sf_dir, i, made) for i in self.whole.get(name) or self.inputs(name)}
        return self.made_by[name](**got) if name in self.made_by else spark.sql(_forms(self.text[name], 0), **got)

    def _kept(self, spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame]) -> DataFrame:
        """The written relation; written anew where a file of its tables is another or newer one than before."""
        files = "file|" + sf_dir
        if files not in made:
            made[files] = {}
        for t in self.tables(name) - set(made[files]):
            made[files][t] = _files(spark, f"{sf_dir}/{t}.parquet")
        key = (spark.sparkContext.applicationId, sf_dir, name, *sorted((t, *made[files][t]) for t in self.tables(name)))
        if key not in self._written:
            self._written[key] = written(self._made(spark, sf_dir, name, made))
        return self._written[key]

    def duckdb(self, name: str, apart: dict[str, str] | None = None, final: str | None = None) -> str:
        """One SQL text for the check, with the relations that it builds on; ``final`` is its last part.

        ``apart`` gives other texts for some relations: what builds on them is made a second time, under names that end in ``_c``.
        """
        apart, order = apart or {}, []
        if apart:
            twice: list[str] = []

            def second(n: str) -> bool:
                if n in apart:
                    return True
                hit = n in self.text and any([second(i) for i in self.inputs(n)])
                if hit and n not in twice:
                    twice.append(n)
                return hit

            for n in re.findall(r"\{(\w+)_c\}", final or "") or [name]:
                second(n)
            copy = Relations()
            copy.text = dict(self.text)
            moved = lambda text: re.sub(r"\{(\w+)\}", lambda m: "{%s_c}" % m[1] if m[1] in apart or m[1] in twice else m[0], text)
            copy.text |= {f"{n}_c": moved(self.text[n]) for n in twice} | {f"{n}_c": text for n, text in apart.items()}
            return copy.duckdb(f"{name}_c" if name in twice or name in apart else name, None, final)

        def visit(n: str) -> None:
            if n in self.text and n not in order:
                for i in self.inputs(n):
                    visit(i)
                order.append(n)

        for n in re.findall(r"\{(\w+)\}", final) if final else [name]:
            visit(n)
        plain = lambda n: re.sub(r"\{(\w+)\}", r"\1", _forms(self.text[n], 1))
        recursive = "RECURSIVE " if any("RECURSIVE" in self.text[n] for n in order) else ""
        return f"WITH {recursive}" + ",\n".join(f"{n} AS ({plain(n)})" for n in order) + "\n" + (re.sub(r"\{(\w+)\}", r"\1", _forms(final, 1)) if final else f"SELECT * FROM {name}")
