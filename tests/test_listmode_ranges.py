import numpy as np
import pytest

from radonframe.sources import listmode

HEADER = {"model_name": "m" * 300, "detectors": [{"id": k, "x": 1.0 * k, "y": 2.0, "z": 3.0} for k in range(6000)], "tof_bin_edges": [-1.0, 0.0, 1.0], "tof_resolution": 1.0, "energy_bin_edges": [0.0], "energy_resolution_at_511": 0.1, "block_duration_ms": 5}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Three files of several chunks each: empty blocks, delayed events, large numbers; one without blocks."""
    rng, folder, want = np.random.default_rng(1), tmp_path_factory.mktemp("listmode"), []
    for name in ("a", "b", "none"):
        whole = listmode.encoded(HEADER, [])[:-1]
        for chunk in range(0 if name == "none" else 3):
            blocks = []
            for k in range(7):
                number = 10 * chunk + k
                prompt, delayed = (rng.integers(0, rng.choice([5, 300, 1 << 40]), (int(n), 5)) for n in rng.choice([0, 1, 3, 40, 400], 2))
                late = delayed if k % 3 else None
                blocks.append((number, prompt, late))
                want += [(name, number, False, *map(int, r)) for r in prompt] + ([(name, number, True, *map(int, r)) for r in delayed] if k % 3 else [])
            part = listmode.encoded({**HEADER}, blocks)
            whole += part[len(listmode.encoded(HEADER, [])) - 1 : -1]
        (folder / f"{name}.bin").write_bytes(whole + b"\0")
    return folder, sorted(want)


def rows(df):
    return sorted((r["file"].rsplit("/", 1)[1].removesuffix(".bin"), r["block"], r["delayed"], *[r[c] for c in listmode.FIELDS]) for r in df.collect())


@pytest.mark.parametrize(("piece", "size"), [(1, 1), (7, 100), (1000, 3000), (listmode.PIECE, listmode.RANGE_BYTES)])
def test_ranges_of_any_size_give_all_events(spark, files, piece, size):
    folder, want = files
    if piece == 1:
        listmode_want = [w for w in want if w[0] == "a"]
        assert rows(listmode.read_binary(spark, f"{folder}/a.bin", piece=64, range_bytes=1)) == listmode_want
        assert listmode.block_ranges(spark, f"{folder}/a.bin", 64, 1).count() == 21
        return
    assert rows(listmode.read_binary(spark, str(folder), piece=piece, range_bytes=size)) == want


def test_only_ranges_with_wanted_blocks(spark, files):
    folder, want = files
    assert rows(listmode.read_binary(spark, str(folder), [3, 21], range_bytes=500)) == [w for w in want if w[1] in (3, 21)]


def test_truncated_files_are_refused(spark, files, tmp_path):
    data = (files[0] / "a.bin").read_bytes()
    for k, cut in enumerate((1, 2, 1000)):
        (tmp_path / f"{k}.bin").write_bytes(data[:-cut])
        with pytest.raises(Exception, match="ends before its last count"):
            listmode.read_binary(spark, f"{tmp_path}/{k}.bin").count()
    (tmp_path / "head.bin").write_bytes(data[:5000])
    with pytest.raises(Exception, match="ends within its header"):
        listmode.read_binary(spark, f"{tmp_path}/head.bin").count()
    assert listmode.read_headers(spark, f"{files[0]}/none.bin").count() == 6000


def test_json_streams_with_their_headers(spark, tmp_path):
    header = {**HEADER, "detectors": HEADER["detectors"][:5], "exam": {"subject_name": None, "subject_id": "s1", "institution": "i", "address": "a", "protocol": "p", "start_ns": 1_500_000_000_000_000_001}}
    rows = [(b, b % 2 == 0, k, k + 1, 0, 1, 2) for b in range(6) for k in range(b)]
    events = spark.createDataFrame(rows, "block long, delayed boolean, detector_1 long, detector_2 long, tof long, energy_1 long, energy_2 long")
    written = listmode.write_ndjson(events, f"file://{tmp_path}/json", header).collect()
    assert sum(r["blocks"] for r in written) == 5 and 1 <= len(written) <= 5
    assert sorted(map(tuple, listmode.read_ndjson(spark, f"{tmp_path}/json").collect())) == rows
    lines = open(written[0]["file"]).read().splitlines()
    assert lines[0] == '{"yardl":{"version":1,"schema":{}}}' and all("timeBlocks" in x for x in lines[2:])
    heads = listmode.ndjson_headers(spark, f"{tmp_path}/json").collect()
    assert len(heads) == len(written)
    for r in heads:
        e = r["header"]["exam"]
        assert (e["subject"]["name"], e["subject"]["id"], e["protocol"], e["startOfAcquisition"]) == (None, "s1", "p", "2017-07-14T02:40:00.000000001")
    scanner = listmode.scanner_of_ndjson(spark, f"{tmp_path}/json").collect()
    assert {(r["detector_id"], r["x"], r["bins"], r["tof_range"]) for r in scanner} == {(k, 1.0 * k, 2, 2.0) for k in range(5)}
    for name, text in (("none", "\n".join(lines[2:])), ("two", "\n".join([*lines[:2], *lines[1:]])), ("late", "\n".join(lines[1:]))):
        (tmp_path / f"{name}.ndjson").write_text(text)
        with pytest.raises(Exception, match="with one header"):
            listmode.ndjson_headers(spark, f"{tmp_path}/{name}.ndjson").collect()
