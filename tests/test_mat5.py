"""MAT-5 files written byte by byte here, against the data source; damage, pruning, round trips and designs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from permafield.functions import design
from permafield.sources import mat5


def tag(o, kind, data, small=False):
    if small and len(data) <= 4:
        return struct.pack(o + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(o + "2I", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def head(o, code, dims, name, flags=0):
    return tag(o, 6, struct.pack(o + "2I", code | flags, 0)) + tag(o, 5, np.array(dims, o + "i4").tobytes()) + tag(o, 1, name.encode(), True)


def num(o, a, name="", code=6, kind=9, dtype="f8", flags=0):
    a = np.atleast_2d(np.asarray(a))
    return tag(o, 14, head(o, code, a.shape, name, flags) + tag(o, kind, a.astype(o + dtype).tobytes(order="F"), True))


def char(o, lines, name=""):
    lines = [lines] if isinstance(lines, str) else lines
    w = max(map(len, lines), default=0)
    flat = "".join(r.ljust(w)[k] for k in range(w) for r in lines)
    return tag(o, 14, head(o, 4, (len(lines), w), name) + tag(o, 4, flat.encode("utf-16-le" if o == "<" else "utf-16-be")))


def cell(o, items, name=""):
    return tag(o, 14, head(o, 1, (1, len(items)), name) + b"".join(items))


def record(o, rows, name=""):
    fields = list(rows[0]) if rows else []
    names = b"".join(f.encode().ljust(8, b"\0") for f in fields)
    return tag(o, 14, head(o, 2, (1, len(rows)), name) + tag(o, 5, struct.pack(o + "i", 8), True) + tag(o, 1, names) + b"".join(r[f] for r in rows for f in fields))


def sparse(o, m, name=""):
    m = np.asarray(m, float)
    c, r = np.nonzero(m.T)
    start = np.searchsorted(c, np.arange(m.shape[1] + 1))
    return tag(o, 14, head(o, 5, m.shape, name) + tag(o, 5, r.astype(o + "i4").tobytes()) + tag(o, 5, start.astype(o + "i4").tobytes()) + tag(o, 9, m[r, c].astype(o + "f8").tobytes()))


def file(o, variables, compress=False):
    out = b"MATLAB 5.0".ljust(124) + struct.pack(o + "H", 0x0100) + (b"IM" if o == "<" else b"MI")
    for v in variables:
        out += struct.pack(o + "2I", 15, len(z := zlib.compress(v))) + z if compress else v
    return out


X = np.array([[k % 2, 1 - k % 2, k * 1.5] for k in range(6)])
XYZ = np.array([[1, 2, 2, 3], [1, 1, 4, 2], [1, 1, 1, 5]])
M = np.diag([2.0, 2, 2, 1])


def spm(o, estimated=True, k=None, contrasts=2):
    empty = num(o, np.zeros((0, 0)))
    x = {"X": num(o, X), "iH": num(o, [1, 2], code=9, kind=2, dtype="u1"), "iC": num(o, [3]), "iB": empty, "iG": empty, "W": sparse(o, np.eye(6) * 0.5), "name": cell(o, [char(o, "a"), char(o, "bü"), char(o, "age")])}
    x |= {"K": k if k is not None else num(o, [[1.0]])}
    con = [{"name": char(o, "a > b"), "STAT": char(o, "T"), "c": num(o, [[1], [-1], [0]])}, {"name": char(o, "any"), "STAT": char(o, "F"), "c": num(o, [[1, 0], [0, 1], [0, 0]])}][:contrasts]
    fields = {"xX": record(o, [x]), "xCon": record(o, con), "xC": record(o, [{"P": char(o, ["c1.nii", "c22.nii"])}]), "xY": record(o, [{"P": cell(o, [char(o, f"s{i}.nii") for i in range(6)])}])}
    if estimated:
        fields["xVol"] = record(o, [{"XYZ": num(o, XYZ, code=12, kind=3, dtype="i2"), "DIM": num(o, [[3], [4], [5]]), "M": num(o, M, code=7, kind=7, dtype="f4")}])
    return record(o, [fields], "SPM")


@pytest.fixture(scope="module")
def mat(spark):
    mat5.register(spark)
    return lambda path, **options: spark.read.format("mat5").options(**options).load(f"file://{path}")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compress", [False, True])
def test_designs_of_either_byte_order(mat, tmp_path, order, compress):
    (tmp_path / "SPM.mat").write_bytes(file(order, [num(order, np.arange(6).reshape(2, 3), "other"), spm(order)], compress))
    read = mat(tmp_path / "SPM.mat")
    d = mat5.read_design(read)
    assert np.array_equal(d.x, X) and d.names == ["a", "bü", "age"] and d.images == [f"s{i}.nii" for i in range(6)]
    assert d.covariate_images == ["c1.nii", "c22.nii"]
    assert np.array_equal(d.whitening, np.eye(6) * 0.5) and np.array_equal(d.affine, M)
    assert d.contrasts["a > b"][0] == "T" and d.contrasts["a > b"][1].tolist() == [1, -1, 0]
    assert d.contrasts["any"][1].tolist() == [[1, 0], [0, 1], [0, 0]]
    built = d.design()
    assert (built.conditions, built.covariates, built.blocks) == ([0, 1], [2], [])
    scheme = design.recognise(built, d.contrasts["a > b"][1])
    assert scheme.kind == "groups" and scheme.n_cond == 2
    rows = {(r["row"], r["col"]): r["value"] for r in mat5.matrix_rows(read, "SPM.xX.X").collect()}
    assert rows == {(i, j): X[i, j] for i in range(6) for j in range(3)}
    elements = sorted(r["element_id"] for r in mat5.mask_elements(read).collect())
    assert elements == sorted((XYZ[0] - 1 + 3 * (XYZ[1] - 1) + 12 * (XYZ[2] - 1)).tolist())


def test_two_factors_name_conditions_and_blocks():
    x = np.array([[k % 2, 1 - k % 2, *(np.arange(3) == k // 2)] for k in range(6)], float)
    d = mat5.Stored(x, [], [2, 3, 4], [], [0, 1], [], {}, None, [], [], None)  # stored the wrong way round
    built = d.design()
    assert built.conditions == [0, 1] and built.blocks == [2, 3, 4]


def test_pruning_leaves_other_variables_unread(mat, tmp_path):
    good, bad = num("<", [[7.0]], "good"), num("<", np.random.default_rng(1).normal(size=(200, 200)), "bad")
    broken = zlib.compress(bad)
    broken = broken[:20000] + bytes(100) + broken[20100:]  # damaged beyond its name
    data = file("<", [good], True) + struct.pack("<2I", 15, len(broken)) + broken
    (tmp_path / "a.mat").write_bytes(data)
    assert [r["values"] for r in mat(tmp_path, variables="good").collect()] == [[7.0]]
    assert mat(tmp_path, within="good").count() == 1
    with pytest.raises(Exception, match="broken|breaks off"):
        mat(tmp_path, variables="bad").collect()
    (tmp_path / "b.mat").write_bytes(file("<", [spm("<")], True))
    below = mat(tmp_path / "b.mat", variables="SPM, good", within="SPM.xCon(2)")
    assert sorted(r["path"] for r in below.collect()) == ["SPM.xCon(2).STAT", "SPM.xCon(2).c", "SPM.xCon(2).name"]
    every = mat(tmp_path / "b.mat")  # filters do not stay with the table
    n = every.count()
    assert every.where("path = 'SPM.xX.X'").count() == 1 and every.count() == n
    a, b = (every.where(F.col("path") == p).select("file", F.col("path").alias(p[-2:])) for p in ("SPM.xX.iH", "SPM.xX.iC"))
    assert a.join(b, "file").count() == 1
    # The parser itself passes over unwanted fields.
    assert [r[1] for r in mat5.parse((tmp_path / "b.mat").read_bytes(), ["SPM"], ["SPM.xX.X"])] == ["SPM.xX.X"]


def test_damage_raises(mat, tmp_path):
    whole = file("<", [spm("<")])
    for name, data in {"short": whole[:100], "cut": whole[:-9], "magic": whole[:124] + b"\0\0" + whole[126:], "hdf": b"\x89HDF\r\n" + whole[6:124] + b"\0\2XX" + whole[128:], "zip": file("<", [spm("<")], True)[:-30]}.items():
        (tmp_path / f"{name}.mat").write_bytes(data)
        with pytest.raises(Exception, match=f"{name}.mat"):
            mat(tmp_path / f"{name}.mat").collect()
    rng = np.random.default_rng(2)
    for _ in range(300):  # broken bytes: a whole result, or an error of ours
        data = bytearray(whole)
        for k in rng.integers(128, len(data), 5):
            data[k] = rng.integers(256)
        try:
            list(mat5.parse(bytes(data)))
        except (mat5.Damaged, TypeError):
            pass
    with pytest.raises(TypeError, match="complex"):
        list(mat5.parse(file("<", [num("<", [[1.0]], "z", flags=0x0800)])))


def test_models_that_are_not_ready_are_refused(mat, tmp_path):
    for name, data, message in (("a", spm("<", estimated=False), "not been estimated"), ("b", spm("<", k=record("<", [{"RT": num("<", [[2.0]])}])), "temporal filter"), ("c", spm("<", contrasts=0), "contrast")):
        (tmp_path / f"{name}.mat").write_bytes(file("<", [data]))
        with pytest.raises(ValueError, match=message):
            mat5.read_design(mat(tmp_path / f"{name}.mat"))


def test_written_files_read_back(spark, mat, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(5):
        (source / f"f{k}.mat").write_bytes(file("<", [spm("<"), num("<", [[k]], "k"), num("<", [[1, 0]], "l", code=9, kind=2, dtype="u1", flags=0x0200)], k % 2 == 0))
    rows = mat(source)
    for compress in ("true", "false"):
        out = tmp_path / f"out-{compress}"
        rows.repartition(3, "file").write.format("mat5").option("compress", compress).mode("append").save(f"file://{out}")
        key = lambda df: sorted(map(repr, df.withColumn("file", F.substring_index("file", "/", -1)).drop("text").collect()))
        text = lambda df: sorted(map(repr, df.where("class <> 'char' or dims[0] < 2").select("path", "text").distinct().collect()))
        assert key(mat(out)) == key(rows) and text(mat(out)) == text(rows)
        assert sorted(p.name for p in out.iterdir()) == [f"f{k}.mat" for k in range(5)]
    binary = spark.read.format("binaryFile").load(f"file://{source}")
    assert mat5.from_bytes(binary, ["SPM"], ["SPM.xX."]).count() == rows.where("variable = 'SPM'").where(F.col("path").startswith("SPM.xX.")).count()
    with pytest.raises(ValueError, match="path"):
        mat5.dump([("SPM..x", "double", [1, 1], [1.0], None, None)])


def test_a_stored_design_becomes_a_job(mat, tmp_path):
    from permafield.plans import job

    (tmp_path / "SPM.mat").write_bytes(file("<", [spm("<")]))
    made = job.from_stored(mat5.read_design(mat(tmp_path / "SPM.mat")), n_perm=50)
    assert made.n_perm == 50 and list(made.contrasts) == ["a > b", "any"] and np.array_equal(made.whitening, np.eye(6) * 0.5)
    assert design.recognise(made.design, made.contrasts["any"]).kind == "groups"
