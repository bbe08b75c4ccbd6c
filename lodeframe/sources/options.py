"""Session options: a typed registry for SET and SHOW. A few steer Spark; the others are kept and reported."""

from __future__ import annotations

from pyspark.sql import SparkSession

_GIB = 1 << 30
_FORMATS = ("none", "ans", "lz4", "snappy", "gdeflate", "deflate", "cascaded", "zstd", "gzip", "bitcomp")
#: Option names with their types and defaults, in the order users know them.
DEFAULTS = {
    "max_num_workers": 1,
    "max_num_partitions": 8,
    "log_level": "info",
    "initial_query_memory": 10 * _GIB,
    "max_query_memory": None,
    "initial_task_manager_memory": 10 * _GIB,
    "max_task_manager_memory": (1 << 64) - 1,
    "join_use_hash_map_cache": False,
    "join_use_unique_keys": True,
    "join_use_perfect_hash": False,
    "join_use_mark_join": True,
    "read_zero_copy_enable": True,
    "use_customized_io": False,
    "io_bounce_buffer_size": 4,
    "io_auxiliary_threads": 8,
    "use_opt_type_for_single_char_col": True,
    "use_in_memory_table_multigpu": False,
    "io_block_size": 2048,
    "io_engine": "io_uring",
    "io_pipelining": True,
    "io_alignment": 4096,
    "use_overlap_mtx": True,
    "use_partition_pruning": False,
    "zone_map_partition_size": 100_000,
    "filter_use_like_shift_and": True,
    "aggregation_use_perfect_hash": False,
    "num_shuffle_partitions": 2,
    "in_memory_table_compression_ratio_threshold": 1.0,
    "in_memory_table_compression_format": "none",
    "in_memory_table_compression_chunk_size": 1 << 16,
    "in_memory_table_secondary_compression_format": "none",
    "in_memory_table_secondary_compression_ratio_threshold": 3.0,
    "in_memory_table_secondary_compression_multiplier_threshold": 1.5,
    "decompress_backend": "default",
    "use_cpu_compression": False,
    "compression_level": 10,
    "in_memory_dummy_copy_multiplier": 1.0,
}
_CHOICES = {
    "log_level": ("trace", "debug", "info", "warn", "err", "critical", "off"),
    "io_engine": ("auto", "io_uring", "psync"),
    "in_memory_table_compression_format": _FORMATS,
    "in_memory_table_secondary_compression_format": _FORMATS,
    "decompress_backend": ("default", "sm", "de"),
}
_LEVELS = {"trace": "TRACE", "debug": "DEBUG", "info": "INFO", "warn": "WARN", "err": "ERROR", "critical": "FATAL", "off": "OFF"}
_OPTIONAL = {"max_query_memory": int}


class Options:
    def __init__(self, spark: SparkSession):
        self.spark, self.values = spark, dict(DEFAULTS)

    def set(self, name: str, text: str) -> None:
        """Parses ``text`` by the option's type; unknown names and wrong values raise."""
        if name not in DEFAULTS:
            raise KeyError(f"invalid option name {name!r}")
        kind = _OPTIONAL.get(name) or type(DEFAULTS[name])
        low = str(text).strip().lower()
        try:
            if kind is bool:
                value = {"true": True, "on": True, "1": True, "false": False, "off": False, "0": False}[low]
            elif kind is str:
                value = low
                if name in _CHOICES and value not in _CHOICES[name]:
                    raise ValueError
            else:
                value = None if name in _OPTIONAL and low == "null" else kind(low)
                if value is not None and value < 0:
                    raise ValueError
        except (KeyError, ValueError):
            raise ValueError(f"invalid value {text!r} of option {name!r}") from None
        self.values[name] = value
        self._apply(name, value)

    def _apply(self, name: str, value) -> None:
        conf = self.spark.conf
        if name == "num_shuffle_partitions":
            conf.set("spark.sql.shuffle.partitions", str(value))
        elif name == "max_num_partitions":
            conf.set("spark.sql.files.minPartitionNum", str(value))
        elif name == "use_partition_pruning":
            conf.set("spark.sql.inMemoryColumnarStorage.partitionPruning", str(value).lower())
        elif name == "zone_map_partition_size":
            conf.set("spark.sql.inMemoryColumnarStorage.batchSize", str(value))
        elif name == "in_memory_table_compression_format":
            conf.set("spark.sql.inMemoryColumnarStorage.compressed", str(value != "none").lower())
        elif name == "log_level":
            self.spark.sparkContext.setLogLevel(_LEVELS[value])

    def show(self, name: str) -> list[tuple[str, str]]:
        """(name, value) of one option or of ``all``, by name; an unknown name has no row."""
        names = sorted(self.values) if name.lower() == "all" else [n for n in self.values if n == name]
        return [(n, option_text(self.values[n])) for n in names]


def option_text(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
