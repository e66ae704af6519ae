"""Layered configuration: plain dicts on the driver, relations where they are data."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that change how processes start; a written configuration must not set them.
BANNED = ("exe", "llama_dir", "args", "command")
CONFIG_PATH = "path string, value string"


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``: dicts merge key by key, all else (lists too) is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(main: str, local: str | None = None) -> dict:
    """A YAML file with an optional overlay, read on the driver."""
    import yaml

    def read(path):
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}

    try:
        return merged(read(main), read(local)) if local else read(main)
    except FileNotFoundError:
        return read(main)


def flat(node: Any, path: str = "") -> list[tuple[str, str]]:
    """(path, value) of every leaf, paths with dots and [n]."""
    if isinstance(node, dict) and node:
        return [x for k, v in node.items() for x in flat(v, f"{path}.{k}" if path else str(k))]
    if isinstance(node, list) and node:
        return [x for n, v in enumerate(node) for x in flat(v, f"{path}[{n}]")]
    return [(path, "" if node is None else str(node))]


def relation(spark: SparkSession, tree: dict) -> DataFrame:
    return spark.createDataFrame(flat(tree), CONFIG_PATH)


def overlaid(base: DataFrame, over: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Overlay of (…keys, path, value) relations; where both have a path, ``over``'s value wins, a null value too."""
    on = [*keys, "path"]
    b = base.select(*on, F.col("value").alias("_base"), F.lit(True).alias("_in_base"))
    o = over.select(*on, F.col("value").alias("_over"), F.lit(True).alias("_in_over"))
    return b.join(o, on, "full_outer").select(*on, F.when(F.col("_in_over"), F.col("_over")).otherwise(F.col("_base")).alias("value"))


def banned_path(node: Any, path: str = "") -> str | None:
    """The first path, depth first, whose key is banned."""
    if isinstance(node, dict):
        for k, v in node.items():
            here = f"{path}.{k}" if path else str(k)
            if k in BANNED:
                return here
            if found := banned_path(v, here):
                return found
    elif isinstance(node, list):
        for n, v in enumerate(node):
            if found := banned_path(v, f"{path}[{n}]"):
                return found
    return None


def engine(tree: dict, name: str, source: str | None = None) -> dict:
    """The section of an engine's source; KeyError if there is none."""
    section = tree["engines"][name]
    chosen = source or section.get("default_source") or "local"
    return {"name": name, "source": chosen, **section["sources"][chosen]}


def endpoint(tree: dict, name: str, source: str | None = None) -> tuple[str, str | None]:
    found = engine(tree, name, source)
    return found["endpoint"], found.get("api_key")


def engine_list(tree: dict) -> list[dict]:
    """name, default source, sources and port of each engine."""
    return [
        {
            "name": n, "default_source": s.get("default_source", "local"), "sources": sorted(s.get("sources", {})),
            "port": next((x["server"].get("port") for x in s.get("sources", {}).values() if x.get("server")), None),
        }
        for n, s in tree.get("engines", {}).items()
    ]


def local_servers(tree: dict) -> dict[str, dict]:
    """Engines with a server section; of several sources the last one's."""
    return {n: x["server"] for n, s in tree.get("engines", {}).items() for x in s.get("sources", {}).values() if x.get("server")}


def model_tag(path: str | None) -> str:
    return (path or "").replace("\\", "/").rsplit("/", 1)[-1]


def wants_gpu(args: list[str]) -> bool:
    """Whether a layer count other than zero follows the offload flag."""
    for flag, value in zip(args, args[1:]):
        if flag in ("-ngl", "--n-gpu-layers"):
            return value.lstrip("-").isdigit() and int(value) != 0
    return False


def has_cuda(listing: str | None, exit_code: int = 0) -> bool | None:
    """Whether a device listing names a CUDA device; None if it failed."""
    if listing is None or exit_code:
        return None
    return any(line.strip().startswith("CUDA") for line in listing.splitlines())


def offloaded(delta_mib: float, model_mib: float, projector_mib: float = 0.0, share: float = 0.8) -> bool:
    return delta_mib >= share * (model_mib + projector_mib)


def device(wanted: str, gpu: bool, fallback: bool) -> tuple[str, bool]:
    """(device, whether to warn); an error where a GPU is a must and there is none."""
    if wanted != "gpu" or gpu:
        return wanted, False
    if not fallback:
        raise RuntimeError("no GPU and no fallback")
    return "cpu", True


DEFAULT_RECOGNISERS = ("llama", "openvino", "paddle")


def recogniser(wanted: str, candidates: Iterable[str], probe: Callable[[str], tuple[bool, str]]) -> dict:
    """The backend to use: a fixed one untested, else the first whose probe passes, else the last resort."""
    if wanted != "auto":
        return {"backend": wanted, "selection_mode": "fixed", "fallback_from": []}
    order = [c for c in candidates if c in DEFAULT_RECOGNISERS] or list(DEFAULT_RECOGNISERS)
    failed = []
    for name in order:
        ok, reason = probe(name)
        if ok:
            return {"backend": name, "selection_mode": "auto", "fallback_from": failed}
        failed.append({"backend": name, "reason": reason})
    return {"backend": "paddle", "selection_mode": "auto", "fallback_from": failed}


def tier(name: str | None) -> str:
    return name if name in ("tiny", "small", "medium") else "small"


def bypassed(host: str, no_proxy: str) -> bool:
    return any(fnmatch.fnmatch(host, p.strip()) for p in no_proxy.split(",") if p.strip())
