import pytest

from driftrank.__main__ import main
from driftrank.sources import binary, text


def test_encode_choose_and_run(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("# ids from 10 on\n" + "\n".join(f"{10 + i * 3 % 7} {10 + i * 5 % 7}" for i in range(60)))
    data = str(tmp_path / "g.bin")
    assert main(["encode", str(tmp_path / "g.txt"), data], spark) == 0
    assert binary.read_header(spark, data) == 7 and binary.read_binary(spark, data).count() == 60
    main(["choose", data, str(tmp_path / "ids"), "-i", "1", "-w", "0.5", "--num", "3", "--ranks", "0", "5"], spark)
    assert text.read_vertices(spark, str(tmp_path / "ids")).count() == 3
    main(["run", "-d", data, "-i", "1", "-y", "1", "-w", "0.5", "-r", "0.1", "-b", "2", "-s", "2", "-s", "4", "-e", "1e-5", "-o", "3", "--top", "2", "--out", str(tmp_path / "state")], spark)
    out = capsys.readouterr().out
    assert "edge_count 60" in out and "ppr_latency" in out and "rounds_pos" in out
    state = spark.read.parquet(str(tmp_path / "state"))
    assert state.count() == 14 and state.where("abs(r) > 1e-5").isEmpty()
    main(["run", "-d", data, "-i", "0", "-y", "0", "-e", "1e-4", "--strategy", "arrow", "--top", "1"], spark)
    assert "1 1 1 0." in capsys.readouterr().out
    for bad in (["-r", "0.1"], ["-n", "1", "-c", "5"], ["-n", "1", "-c", "50", "-l", "50"]):
        with pytest.raises(SystemExit):
            main(["run", "-d", data, "-i", "1", "-y", "1", *bad], spark)
