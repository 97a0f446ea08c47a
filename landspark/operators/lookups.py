"""Joins by name, code, prefix and contained name, and their cascades.

The lookup tables come from gazetteers and court lists. Spark broadcasts them by itself when the measured size allows; only
places by code, of which a few have most of the cases, are marked for it up to a bound.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

try:
    import ahocorasick
except ImportError:  # names are then found by joins
    ahocorasick = None

from .. import constants as K
from ..functions.text import blank_to_null, normalize_text, normalize_upper

AUTOMATON = 4_000_000  # characters of names, at most, in an automaton
PLACES = 1_000_000     # places, at most, that are broadcast (about 70 MB)


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Primary rows plus the fallback rows whose key the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(key), key, "left_anti"))


def fallback_seats(spark) -> DataFrame:
    return spark.createDataFrame(K.FALLBACK_SEATS, "code int, lon double, lat double, name string")


def lookup_one(df: DataFrame, key: str, value) -> DataFrame:
    found = df.filter(F.col(key) == value).limit(1)
    if not found.take(1):
        raise LookupError(f"no row with {key} = {value!r}")
    return found


def resolve_alias(normal: Column, aliases: dict[str, str] = K.NAME_ALIASES) -> Column:
    table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
    return F.coalesce(F.try_element_at(table, normal), normal)


def names_of(gazetteer: DataFrame) -> DataFrame:
    """One row per normalised name; where two share it the later code wins."""
    named = gazetteer.withColumn("_norm", normalize_text("name"))
    return named.groupBy("_norm").agg(F.max_by(F.struct("code", "name", "lon", "lat"), "code").alias("place"))


def join_by_name(df: DataFrame, name: str, gazetteer: DataFrame, out: str = "place",
                 aliases: dict[str, str] = K.NAME_ALIASES, how: str = "left") -> DataFrame:
    """Add the gazetteer entry (``code, name, lon, lat``) of a written name."""
    keyed = df.withColumn("_norm", resolve_alias(normalize_text(name), aliases))
    return keyed.join(names_of(gazetteer).withColumnRenamed("place", out), "_norm", how).drop("_norm")


def join_by_code(df: DataFrame, code: str, gazetteer: DataFrame, out: str = "place", most: int = PLACES) -> DataFrame:
    """Add the gazetteer entry of a code. A few codes have most of the rows, so up to ``most`` entries, counted first, are
    broadcast; beyond that it is a join like any other."""
    places = gazetteer.select(F.col("code").alias("_code"), F.struct("code", "name", "lon", "lat").alias(out))
    if gazetteer.count() <= most:
        places = F.broadcast(places)
    return df.join(places, df[code] == places["_code"], "left").drop("_code")


def _first_found(names: list[str]):
    """Texts with the first of the names, in the order of the list, that each contains."""
    def work(batches):
        machine = ahocorasick.Automaton()
        for k, n in enumerate(names):
            machine.add_word(n, k)
        machine.make_automaton()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            best = [min((k for _, k in machine.iter(t)), default=None) for t in texts] if names else [None] * len(texts)
            kept = [k for k, b in enumerate(best) if b is not None]
            yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in kept], pa.string()), pa.array([names[best[k]] for k in kept], pa.string())],
                                             names=[batch.schema.names[0], "_found"])
    return work


def contained_names(texts: DataFrame, text: str, names: DataFrame, name: str, order: str,
                    min_len: int = 1, prefer: str = "first") -> DataFrame:
    """For each distinct text the name it contains: the first in ``order``, or the longest.

    Up to ``AUTOMATON`` characters of names, counted first, become one automaton that goes to the tasks and reads each
    text once, whatever its length. With more of them, every stretch of the text as long as some name is an equi-join
    key. Either way no pair of text and name is formed that does not match.
    """
    names = names.filter(F.length(name) >= min_len)
    distinct = texts.select(text).distinct().filter(F.col(text) != "")
    rank = F.col(order) if prefer == "first" else F.struct(-F.length(name), F.col(order))
    if ahocorasick and (names.agg(F.sum(F.length(name) + 1)).first()[0] or 0) <= AUTOMATON:
        best = names.groupBy(F.col(name).alias("_found")).agg(F.min_by(F.struct(*names.columns), rank).alias("hit"), F.min(rank).alias("_rank"))
        listed = [r[0] for r in best.orderBy("_rank", "_found").select("_found").collect()]
        found = distinct.mapInArrow(_first_found(listed), f"`{text}` string, _found string")
        return found.join(best.select("_found", "hit"), "_found").select(text, "hit")
    lengths = names.select(F.length(name).alias("_len")).distinct()
    # the set of lengths is at most as long as the longest name
    cuts = (distinct.crossJoin(F.broadcast(lengths)).filter(F.length(text) >= F.col("_len"))
            .withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_len") + 1)))
            .select(text, F.substring(F.col(text), F.col("_at"), F.col("_len")).alias(name)).distinct())
    hits = cuts.join(names, name)
    return hits.groupBy(text).agg(F.min_by(F.struct(*names.columns), rank).alias("hit"))


def join_by_contained_name(df: DataFrame, text: str, gazetteer: DataFrame, order: str = "code",
                           min_len: int = 5, prefer: str = "first", out: str = "place") -> DataFrame:
    """Add the gazetteer entry whose name occurs in a text, both without accents and upper case."""
    names = gazetteer.select(normalize_upper("name").alias("_name"), "code", "name", "lon", "lat",
                             F.col(order).alias("_ord"))
    keyed = df.withColumn("_text", normalize_upper(text))
    hits = contained_names(keyed, "_text", names, "_name", "_ord", min_len, prefer).select(
        "_text", F.struct("hit.code", "hit.name", "hit.lon", "hit.lat").alias(out))
    return keyed.join(hits, "_text", "left").drop("_text")


def split_prefix_municipality(df: DataFrame, name: str, gazetteer: DataFrame,
                              special=K.PREFIX_RULES, unknown: str = K.STATE_NAME,
                              no_prefix: str = K.RECIFE[3]) -> DataFrame:
    """"Town - Community" split into ``municipio`` and ``comunidade`` when the part before the first
    dash is a municipality; a name without a dash belongs to the capital."""
    bits = F.split(name, " - ", 2)
    prefix, rest = normalize_upper(bits[0]), F.trim(F.get(bits, F.lit(1)))
    places = (gazetteer.groupBy(normalize_upper("name").alias("_prefix"))
              .agg(F.max_by("name", "code").alias("_place")))
    out = df.withColumn("_prefix", prefix).join(places, "_prefix", "left")
    dashed = F.col(name).contains(" - ")
    town = F.when(~dashed, no_prefix).when(F.col("_place").isNotNull(), F.col("_place"))
    known = F.col("_place").isNotNull()
    for start, place in special:
        town = town.when(F.col("_prefix").startswith(start), place)
        known = known | F.col("_prefix").startswith(start)
    return out.withColumns({"municipio": town.otherwise(unknown),
                            "comunidade": F.when(dashed & known, rest).otherwise(F.col(name))}
                           ).drop("_prefix", "_place")


def attach_geometry(df: DataFrame, layer: DataFrame, key: str) -> DataFrame:
    return df.join(layer.select(key, "geom"), key)


def override_blank(base: DataFrame, curated: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Curated values where the base is blank."""
    extra = curated.select(key, *[F.col(c).alias("_c_" + c) for c in columns])
    out = base.join(extra, key, "left")
    return out.withColumns({c: F.coalesce(blank_to_null(c), F.col("_c_" + c)) for c in columns}
                           ).drop(*["_c_" + c for c in columns])


def _seat_info(coverage: DataFrame) -> Column:
    return F.struct(F.col("comarca_nome").alias("sede_nome"), F.col("comarca_ibge").alias("sede_ibge"),
                    "municipios_abrangidos", F.col("total_municipios_comarca").alias("total"))


def _seat_lookup(coverage: DataFrame, key: Column, name: str, out: str) -> DataFrame:
    """One row per key, the first in reading order, so that the join never multiplies cases."""
    return (coverage.withColumn(name, key).groupBy(name)
            .agg(F.min_by(_seat_info(coverage), F.struct("seq", "municipio_ibge")).alias(out))
            .filter(F.col(name).isNotNull()))


def assign_state_seat(cases: DataFrame, coverage: DataFrame) -> DataFrame:
    """Seat of a state case: as a seat municipality, as a covered one, by the name of the seat."""
    seats = coverage.filter("eh_sede")
    by_seat = _seat_lookup(seats, F.col("comarca_ibge"), "_k1", "_s1")
    by_town = _seat_lookup(coverage, F.col("municipio_ibge"), "_k2", "_s2")
    by_name = _seat_lookup(seats, F.lower("comarca_nome"), "_k3", "_s3")
    return (cases.join(by_seat, cases["municipio_ibge"] == by_seat["_k1"], "left")
            .join(by_town, cases["municipio_ibge"] == by_town["_k2"], "left")
            .join(by_name, F.lower(cases["municipio_nome"]) == by_name["_k3"], "left")
            .withColumn("seat", F.coalesce("_s1", "_s2", "_s3"))
            .drop("_k1", "_k2", "_k3", "_s1", "_s2", "_s3"))


def distinct_coverage(coverage: DataFrame) -> DataFrame:
    return coverage.select("subsecao_nome", "subsecao_sede_nome", "subsecao_ibge",
                           "total_municipios_subsecao", "municipios_abrangidos").distinct()


def assign_federal_seat(cases: DataFrame, coverage: DataFrame, rooms: dict[int, str] = K.ROOM_SUBSECTIONS,
                        default: str = K.DEFAULT_SUBSECTION, chamber: str = "orgao_julgador_nome") -> DataFrame:
    """Subsection of a federal case: by room number, by the first word of a subsection in the
    municipality name, else the default. Ties go to the first subsection by name."""
    sections = distinct_coverage(coverage)
    table = F.create_map(*[F.lit(v) for pair in rooms.items() for v in pair])
    room = F.regexp_extract(F.coalesce(F.col(chamber), F.lit("")), r"(\d+)ª\s*Vara", 1).try_cast("int")
    words = sections.select(F.lower(F.split(F.trim("subsecao_nome"), r"\s+")[0]).alias("_word"),
                            F.col("subsecao_nome").alias("_sub"))
    named = contained_names(cases.select(F.lower("municipio_nome").alias("_town")), "_town",
                            words, "_word", "_sub").select("_town", F.col("hit._sub").alias("_by_word"))
    info = (sections.groupBy(F.col("subsecao_nome").alias("_target"))
            .agg(F.min(F.struct(F.col("subsecao_sede_nome").alias("sede_nome"),
                                F.col("subsecao_ibge").alias("sede_ibge"), "municipios_abrangidos",
                                F.col("total_municipios_subsecao").alias("total"))).alias("seat")))
    return (cases.withColumn("_town", F.lower("municipio_nome")).join(named, "_town", "left")
            .withColumn("_target", F.coalesce(F.try_element_at(table, room), "_by_word", F.lit(default)))
            .join(info, "_target", "left").drop("_town", "_by_word", "_target"))


