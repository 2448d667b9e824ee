"""Columns and types of the stages, and the checks at their boundaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_CHAINS = ["add", "pull", "fill", "rest", "bid_depth", "ask_depth"]

EVENT = T.StructType([T.StructField(n, t) for n, t in [("seq", T.LongType()), ("ts_ns", T.LongType()), ("action", T.StringType()), ("side", T.StringType()), ("price_int", T.LongType()), ("size", T.LongType()), ("order_id", T.LongType()), ("flags", T.IntegerType())]])

#: Flag bits and the price that stands for none.
FLAG_SNAPSHOT, FLAG_LAST, NO_PRICE = 32, 128, (1 << 63) - 1

BINS = T.StructType([T.StructField(n, t) for n, t in [
    ("ts_ns", T.LongType()), ("bin_seq", T.LongType()), ("bin_start_ns", T.LongType()), ("bin_end_ns", T.LongType()), ("bin_event_count", T.LongType()), ("event_id", T.LongType()),
    ("mid_price", T.DoubleType()), ("spot_ref_price_int", T.LongType()), ("best_bid_price_int", T.LongType()), ("best_ask_price_int", T.LongType()), ("book_valid", T.BooleanType()),
]])

#: Columns of the silver and the gold stage.
SILVER_FLOAT = "add_mass pull_mass fill_mass rest_depth bid_depth ask_depth v_add v_pull v_fill v_rest_depth v_bid_depth v_ask_depth a_add a_pull a_fill a_rest_depth a_bid_depth a_ask_depth j_add j_pull j_fill j_rest_depth j_bid_depth j_ask_depth".split()
SILVER_INT = {"best_ask_move_ticks": "int", "best_bid_move_ticks": "int", "ask_reprice_sign": "tinyint", "bid_reprice_sign": "tinyint", "microstate_id": "tinyint", "chase_up_flag": "tinyint", "chase_down_flag": "tinyint", "last_event_id": "bigint"}
GOLD_FLOAT = "pressure_variant vacuum_variant composite composite_d1 composite_d2 composite_d3 flow_score".split()
GOLD_INT = {"state5_code": "tinyint", "flow_state_code": "tinyint"}
SILVER, GOLD = frozenset(SILVER_FLOAT) | frozenset(SILVER_INT), frozenset(GOLD_FLOAT) | frozenset(GOLD_INT)
assert not SILVER & GOLD

ROLES = ("grid_index", "metadata", "velocity", "indicator")


def require(df: DataFrame, columns: list[str], where: str) -> DataFrame:
    """The frame, if it has the columns; checked on the schema alone, without reading data."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{where} lacks columns {missing}")
    return df


def allowed(df: DataFrame, allow: frozenset[str], keys: tuple[str, ...] = ("bin_seq", "k")) -> DataFrame:
    """The keys and those columns that the stage may carry."""
    return df.select(*[c for c in df.columns if c in keys or c in allow])


def check_wire(fields: list[tuple[str, str, str]]) -> None:
    """Validate ``(name, type, role)`` fields of a stream; a grid index and the last event id have to be there."""
    names = [n for n, _, _ in fields]
    if len(set(names)) != len(names):
        raise ValueError("field names repeat")
    for need in (("k", "int32", "grid_index"), ("last_event_id", "int64", "metadata")):
        if need not in fields:
            raise ValueError(f"fields lack {need}")
    for name, kind, role in fields:
        if role not in ROLES:
            raise ValueError(f"{name}: unknown role {role}")
        if role == "velocity" and kind != "float64" or role == "indicator" and kind not in ("int8", "int32"):
            raise ValueError(f"{name}: {role} can't be {kind}")


def from_arrow(schema: pa.Schema) -> T.StructType:
    """The feature-store types of an Arrow schema: small integers become int, whatever else isn't known double."""
    def kind(t: pa.DataType) -> T.DataType:
        for test, found in ((pa.types.is_float64, T.DoubleType()), (pa.types.is_float32, T.FloatType()), (pa.types.is_int64, T.LongType()), (pa.types.is_integer, T.IntegerType()), (pa.types.is_boolean, T.BooleanType()), (lambda x: pa.types.is_string(x) or pa.types.is_large_string(x), T.StringType())):
            if test(t):
                return found
        return T.DoubleType()

    return T.StructType([T.StructField(f.name, kind(f.type)) for f in schema])
