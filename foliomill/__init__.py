"""Document corpus extraction, quality scoring and selection on Spark.

Every public function takes DataFrames and returns DataFrames; nothing is collected to the driver.
"""

from foliomill.operators.engines import ColumnEngine, FrameEngine, isolated_engine, registered_engines, register_engine
from foliomill.operators.scoring import score_quality
from foliomill.plans.corpus import convert_corpus, convert_to_tables
from foliomill.schemas import (
    CANDIDATES,
    FILES,
    IMAGE_EXTENSIONS,
    QUALITY,
    RESULTS,
    STATS,
    SUPPORTED_EXTENSIONS,
)
from foliomill.sources.files import manifest, scan_files
from foliomill.sources.walk import read_contents, walk_files

__all__ = [
    "CANDIDATES",
    "ColumnEngine",
    "FILES",
    "FrameEngine",
    "IMAGE_EXTENSIONS",
    "QUALITY",
    "RESULTS",
    "STATS",
    "SUPPORTED_EXTENSIONS",
    "convert_corpus",
    "convert_to_tables",
    "isolated_engine",
    "manifest",
    "read_contents",
    "register_engine",
    "registered_engines",
    "scan_files",
    "score_quality",
    "walk_files",
]
