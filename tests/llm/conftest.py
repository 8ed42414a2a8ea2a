"""Skips these tests where the subpackage is not there."""

from __future__ import annotations

import pytest

pytest.importorskip("kvlume.llm")
