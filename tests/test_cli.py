"""The command line, end to end."""

import io

import pytest

from quarry import cli

from .test_compile import FAULTY, HELLO


@pytest.fixture
def run(spark, tmp_path):
    def of(*sources, mode="reference"):
        paths = []
        for i, s in enumerate(sources):
            at = tmp_path / f"s{i}.cbl"
            if s is not None:
                at.write_bytes(s if isinstance(s, bytes) else s.encode())
            paths.append(str(at))
        out, err = io.StringIO(), io.StringIO()
        return cli.compile_files(spark, paths, mode=mode, out=out, err=err), out.getvalue(), err.getvalue(), paths

    return of


def test_one_good_file(run):
    code, out, err, _ = run(HELLO)
    assert (code, err) == (0, "") and out.startswith("Program HELLO\n\n  Module HELLO") and out.endswith("MOVE 1 -> WS-COUNT\n")


def test_what_can_be_wrong(run):
    code, out, err, paths = run(None)
    assert (code, out, err) == (1, "", f"error: file not found: {paths[0]}\n")
    code, out, err, paths = run("DISPLAY @.\n")
    assert (code, out, err) == (2, "", f"lex error: {paths[0]}:1:9: unexpected character '@'\n")
    code, out, err, _ = run(FAULTY)
    assert code == 2 and out.startswith("Program FAULTY") and "Semantic Diagnostics:" in err and "undefined variable: 'B'" in err
    code, out, err, _ = run("PROCEDURE DIVISION USING X.\nP.\n GOBACK.\n")
    assert code == 2 and out == "" and "parse error" in err


def test_several_files(run):
    code, out, err, paths = run(HELLO, None, b"IDENTIFICATION DIVISION.\nPROGRAM-ID. B.\n* \xff\n", "")
    assert code == 1 and out.count("Program HELLO") == 1 and "Program B" in out and err == f"error: file not found: {paths[1]}\n"


def test_main(spark, tmp_path, capsys):
    (tmp_path / "h.cbl").write_text(HELLO)
    assert cli.main([str(tmp_path / "h.cbl")], spark) == 0 and "Program HELLO" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([], spark)
