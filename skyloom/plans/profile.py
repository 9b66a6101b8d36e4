"""Run profiles: the two figures that trade accuracy against time."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Name of the variable that picks a profile.
VARIABLE = "ASTRO_RESOURCE_PROFILE"


@dataclass(frozen=True)
class Profile:
    name: str
    z_step: float
    detection_sigma: float

    def settings(self, cores: int) -> dict[str, str]:
        """Session settings for a cluster of ``cores``: two to three waves of shuffle tasks, adaptive execution on."""
        return {"spark.sql.shuffle.partitions": str(max(8, 3 * cores)), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}

    def __str__(self) -> str:
        return f"{self.name}: z_step={self.z_step}, detection_sigma={self.detection_sigma}"


PROFILES = {"low": Profile("low", 0.05, 2.0), "medium": Profile("medium", 0.02, 1.5), "high": Profile("high", 0.02, 1.5)}


def resources(spark: SparkSession) -> tuple[float, int]:
    """Memory (GB) and cores of the session: of its executors as configured, or of the machine under a local master."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        return os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") / 1e9, sc.defaultParallelism
    conf = sc.getConf()
    size = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get("spark.executor.memory", "1g").lower())
    each = int(size[1]) * {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "": 1}[size[2]] / 1e9 if size else 1.0
    return each * max(1, int(conf.get("spark.executor.instances", "1"))), sc.defaultParallelism


def summary(spark: SparkSession) -> str:
    """Session, resources and the profile they lead to, a line each."""
    memory, cores = resources(spark)
    return "\n".join([f"spark: {spark.version} on {spark.sparkContext.master}", f"memory: {memory:.1f} GB", f"cores: {cores}", f"profile: {choose(memory_gb=memory, cores=cores)}"])


def choose(name: str | None = None, memory_gb: float = 8.0, cores: int = 8) -> Profile:
    """The named profile, else the variable's, else by memory and cores (``resources`` finds them). An unknown name raises."""
    name = name or os.environ.get(VARIABLE)
    if name:
        return PROFILES[name.lower()]
    if memory_gb < 4 or cores <= 2:
        return PROFILES["low"]
    return PROFILES["medium"] if memory_gb < 8 or cores <= 4 else PROFILES["high"]
