"""Fixed values. They decide results, so they are stated as plain text."""

from __future__ import annotations

# Folders and files that are never scanned.
DEFAULT_EXCLUDES = [
    "__pycache__",
    ".git",
    "venv",
    ".venv",
    "node_modules",
    ".pytest_cache",
    "build",
    "dist",
    ".env*",
    "python_embeded",
    "python_embedded",
    ".vscode",
    ".vs",
]

# The closed set of callable types.
CALLABLE_TYPES = ["function", "class", "coroutine", "generator"]

# Decorators that mark a method.
METHOD_DECORATORS = ["staticmethod", "classmethod", "property"]

# Folder names that mark test code.
TEST_FOLDERS = ["test", "tests"]

# Path parts that say nothing about the code. Account names are not
# listed; pass them to ``path_tags`` as ``drop``.
GENERIC_PARTS = [
    "src", "lib", "utils", "common", "shared", "core", "base",
    "main", "app", "code", "source", "python", "py",
    "home",
]

# Stop words removed from path tags.
STOP_WORDS = [
    "the", "and", "or", "a", "an", "is", "to", "of", "in", "for",
    "on", "with", "at", "by", "as", "this", "that", "it", "be",
    "are", "was", "were", "been", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may",
    "might", "can", "must", "shall", "from", "up", "out", "if",
    "then", "than", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "also",
    "but", "very", "just", "now", "here", "there", "between",
    "into", "through", "during", "before", "after", "above",
    "below", "over", "under", "again", "further", "once", "two",
]

# CIDv1 (01), raw codec (55), sha2-256 (12), 32 bytes (20), and the
# lower-case base32 alphabet of RFC 4648.
CID_PREFIX_HEX = "01551220"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"

# Fixed value: size of the identifier columns of the two catalog tables.
CID_MAX_CHARS = 255
