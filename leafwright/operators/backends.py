"""Backends that run in this process or next to it: what a machine offers, which one is taken, and what it falls back to.

Facts of a machine are a row; probes and choices are expressions on it, so a
fleet of workers is one table. ``facts`` gathers the row of the machine it runs on.
"""

from __future__ import annotations

import importlib.util
import os
import socket
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FREE_MIB = 3000  # what a model server asks of the GPU's memory by default
#: The backends that a configuration can force, and the files that the ONNX one needs.
FORCED = ("gpu", "openvino", "cpu")
ONNX_FILES = ("PP-OCRv6_small_det_onnx/inference.onnx", "PP-OCRv6_small_rec_onnx/inference.onnx")


def server_probe(exe: Column, model: Column, projector: Column, listening: Column, free_mib: Column, need_mib: Column) -> Column:
    """struct(ok, reason) of a model server: its program and files must be there; memory counts only if it has to be started.

    Memory that isn't known stops nothing; null facts are facts that fail.
    """
    there = lambda c: F.coalesce(c, F.lit(False))
    short = ~there(listening) & (free_mib < F.coalesce(need_mib, F.lit(FREE_MIB)))
    reason = F.when(~there(exe), "exe").when(~there(model), "model").when(~there(projector), "mmproj").when(F.coalesce(short, F.lit(False)), "memory")
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.when(there(listening), "running").otherwise("ok")).alias("reason"))


def onnx_probe(package: Column, detector: Column, recogniser: Column) -> Column:
    """Whether the package and both model files are there."""
    return F.coalesce(package & detector & recogniser, F.lit(False))


def in_process(forced: Column, device: Column, cuda_devices: Column) -> Column:
    """gpu, openvino or cpu: what is forced, else the wanted device if it is there; openvino is never taken unasked."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(plain(forced).isin(*FORCED), plain(forced)).when((plain(device) == "gpu") & (cuda_devices >= 1), "gpu").otherwise("cpu")


def degraded(backend: Column, loads: Column) -> Column:
    """What runs in the end, ``loads`` being an array of what can be loaded: others fall back to the CPU; null if that fails too."""
    return F.when(F.array_contains(loads, backend), backend).when(F.array_contains(loads, F.lit("cpu")), "cpu")


def load(backend: str, loaders: dict[str, Callable[[], object]]) -> tuple[str, object, list[str]]:
    """(backend, what was loaded, faults): ``backend``, else the CPU's; the CPU's own fault is raised."""
    faults = []
    if backend != "cpu":
        try:
            return backend, loaders[backend](), faults
        except Exception as e:  # noqa: BLE001 - any fault of a backend sends to the next
            faults.append(f"{backend}: {type(e).__name__}: {e}")
    return "cpu", loaders["cpu"](), faults


def facts(server: dict, folder: str = "", models: str = "", free_mib: int | None = None) -> dict:
    """This machine's facts for the probes, from an engine's server section; nothing is started."""
    exe = server.get("exe") or ""
    exists = lambda p: bool(p) and os.path.exists(p)
    port, listening = int(server.get("port") or 0), False
    if port:
        with socket.socket() as s:
            s.settimeout(0.5)
            listening = s.connect_ex(("127.0.0.1", port)) == 0
    package = lambda n: importlib.util.find_spec(n) is not None
    return {
        "exe": exists(exe if os.path.isabs(exe) or not folder else os.path.join(folder, exe)), "model": exists(str(server.get("model") or "").strip()),
        "mmproj": exists(str(server.get("mmproj") or "").strip()), "listening": listening, "free_mib": free_mib, "need_mib": int(server.get("vram_required_mib") or FREE_MIB),
        "openvino": package("openvino"), "paddle": package("paddleocr"), "detector": exists(os.path.join(models, ONNX_FILES[0])), "recogniser": exists(os.path.join(models, ONNX_FILES[1])),
    }
