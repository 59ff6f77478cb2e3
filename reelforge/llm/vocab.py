"""Where vocabulary files lie: a folder that is a parameter, by default that of the installed public tokenizers."""

from __future__ import annotations

import importlib.util
import os

FOLDER = "/opt/tokenizers"


def vocabulary(name: str, folder: str | None = None) -> str:
    if folder is None and importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return os.path.join(folder or FOLDER, name)
