import importlib
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    for name in ("p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "v1_hvg_stats"):
        assert name in q


def test_core_does_not_need_the_text_operators():
    """No module outside the llm folder imports it; the entry adds it only where it is."""
    for path in (ROOT / "wavelattice").rglob("*.py"):
        if "llm" not in path.parts:
            assert "wavelattice.llm" not in path.read_text(encoding="utf-8"), path


def test_entry_runs(spark):
    folder = Path("/root/testdata/sf0.001")
    if folder.exists():
        import __spark_entry__ as entry

        assert entry.entry(spark).count() > 0


def test_import_without_text_operators(monkeypatch):
    import importlib.util as u

    import __spark_entry__ as entry

    real = u.find_spec
    monkeypatch.setattr(u, "find_spec", lambda name, *a: None if name.startswith("wavelattice.llm") else real(name, *a))
    assert "p8_found" not in entry.queries() and "p2_found" in entry.queries()
    assert importlib and sys
