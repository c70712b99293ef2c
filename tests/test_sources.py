import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusforge.functions.calls import call_dosage, ds_dosage, gt_dosage, letter_dosage, number_dosage
from locusforge.model import Genotypes
from locusforge.sources import formats
from locusforge.sources.genotypes import Filters, read_genotypes, read_hapmap, read_plink, read_store, read_vcf, store_is_fresh, write_store


def vcf(path, rows, samples=("S1", "S2", "S3"), opener=open):
    with opener(path, "wt") as f:
        f.write("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples) + "\n")
        for r in rows:
            head, calls = r.split(" : ")
            chrom, pos, name, ref, alt, *fmt = head.split()
            f.write("\t".join([chrom, pos, name, ref, alt, ".", "PASS", ".", fmt[0] if fmt else "GT", *calls.split()]) + "\n")
    return str(path)


def names(geno):
    return [r.marker for r in geno.markers.orderBy("marker_idx").collect()]


def test_call_forms(spark):
    cases = {"0/0": 0, "0|1": 1, "1/1": 2, "./.": -9, "./1": -9, ".": -9, "": -9, "0/2": -9, "1": 1, "1/1/1": 3, "0/1/.": -9}
    assert {k: call_dosage(k) for k in cases} == cases
    assert call_dosage("0/2", 2) == 1 and call_dosage("1/2", 2) == -9
    got = {r.g: r.d for r in spark.createDataFrame([(k,) for k in cases], "g string").select("g", gt_dosage(F.col("g")).alias("d")).collect()}
    assert {k: (-9 if d is None else d) for k, d in got.items()} == cases
    ds = {"0.4": 0, "1.5": 2, "0.5": 0, "2.5": 2, "-1": -9, "x": -9, "nan": -9}
    assert {k: number_dosage(k) for k in ds} == ds
    got = {r.g: r.d for r in spark.createDataFrame([(k,) for k in ds], "g string").select("g", ds_dosage(F.col("g")).alias("d")).collect()}
    assert {k: (-9 if d is None else d) for k, d in got.items()} == ds
    letters = {"A": 0, "C": 2, "AC": 1, "CA": 1, "M": 1, "CC": 2, "N": -9, "NN": -9, "-": -9, "G": -9, "R": -9, "a": 0}
    assert {k: letter_dosage(k, "A", "C") for k in letters} == letters


def test_vcf_imputes_and_names(spark, tmp_path):
    rows = ["1 10 rs1 A G : 0/0 0/1 1/1", "1 20 . C T : 0|0 ./. 0|1"]
    for name, opener in (("a.vcf", open), ("a.vcf.gz", gzip.open)):
        g = read_genotypes(spark, vcf(tmp_path / name, rows, opener=opener))
        assert g.matrix().tolist() == [[0, 0], [1, 0], [2, 1]] and g.samples == ["S1", "S2", "S3"]
        assert names(g) == ["rs1", "1:20:C:T"] and g.imputed


def test_vcf_filters(spark, tmp_path):
    rows = ["1 1 poly A G : 0/0 0/1 1/1", "1 2 all_ref A G : 0/0 0/0 0/0", "1 3 all_alt A G : 1/1 1/1 1/1", "1 4 all_het A G : 0/1 0/1 0/1", "1 5 missing_ref A G : ./. 0/0 0/0", "1 6 none A G : ./. ./. ./."]
    assert names(read_vcf(spark, vcf(tmp_path / "m.vcf", rows), Filters(drop_monomorphic=True))) == ["poly", "all_het"]
    assert "none" not in names(read_vcf(spark, vcf(tmp_path / "m.vcf", rows)))
    rows = ["1 1 keep A G : 0/0 0/1 1/1 0/1", "1 2 indel C CT : 0/0 0/1 1/1 0/1", "1 3 missing A G : ./. ./. 0/1 1/1", "1 4 low_maf A G : 0/0 0/0 0/0 0/1"]
    g = read_vcf(spark, vcf(tmp_path / "q.vcf", rows, ("A", "B", "C", "D")), Filters(include_indels=False, max_missing=0.25, min_maf=0.2))
    assert names(g) == ["keep"] and g.matrix()[:, 0].tolist() == [0, 1, 2, 1]


def test_vcf_alleles_dosages_and_order(spark, tmp_path):
    rows = ["1 1 multi A G,T : 0/1 1/2 2/2", "1 2 ds A G GT:DS : ./.:0.9 0/0:0 1/1:2", "2 3 only A G DS : 1.6 0.2 1", "2 4 tri A G : 0/1/1 0/0/0 1/1/1"]
    g = read_vcf(spark, vcf(tmp_path / "x.vcf", rows))
    assert names(g) == ["multi_G", "multi_T", "ds", "only", "tri"]
    assert g.matrix()[:, 2:].T.tolist() == [[1, 0, 2], [2, 0, 1], [2, 0, 3]] and g.matrix()[2, 1] == 2
    assert names(read_vcf(spark, vcf(tmp_path / "x.vcf", rows), Filters(split_multiallelic=False))) == ["ds", "only", "tri"]
    twice = read_vcf(spark, vcf(tmp_path / "d.vcf", ["1 1 a A G : 0/0 0/1 1/1"], ("S1", "S1", "S2")))
    assert twice.samples == ["S1", "S2"] and twice.matrix()[:, 0].tolist() == [0, 2]
    with pytest.raises(ValueError):
        read_vcf(spark, "x.bcf")


def test_many_records_keep_their_order(spark, tmp_path):
    rows = [f"1 {i + 1} m{i} A G : {'0/1 0/0 1/1' if i % 2 else '1/1 0/1 0/0'}" for i in range(3000)]
    assert names(read_vcf(spark, vcf(tmp_path / "l.vcf", rows))) == [f"m{i}" for i in range(3000)]


HEAD = "rs# alleles chrom pos strand assembly# center protLSID assayLSID panelLSID QCcode S1 S2".replace(" ", "\t")


def hapmap(path, rows):
    path.write_text("\n".join([HEAD, *["\t".join([*r[:4], *["x"] * 7, *r[4:]]) for r in rows]]) + "\n")
    return str(path)


def test_hapmap(spark, tmp_path):
    p = hapmap(tmp_path / "a.hmp.txt", [("snp1", "A/C", "1", "100", "A", "C"), ("snp2", "A/T", "1", "200", "AT", "AA"), ("snp3", "G/C", "1", "300", "N", "C"), ("bad", "A/C", "1", "0", "A", "C")])
    g = read_genotypes(spark, p)
    assert g.matrix().tolist() == [[0, 1, 2], [2, 0, 2]]
    p = hapmap(tmp_path / "b.hmp.txt", [("i", "A/-", "1", "100", "A", "A"), ("n", "A/C", "1", "200", "N", "N"), ("m", "A/C", "1", "300", "A", "A")])
    assert read_hapmap(spark, p, Filters(include_indels=False, drop_monomorphic=True)).matrix().shape == (2, 0)


def plink(prefix, matrix, chrom="1"):
    n, m = matrix.shape
    code = {2: 0, -9: 1, 1: 2, 0: 3}
    raw = bytearray(b"\x6c\x1b\x01")
    for j in range(m):
        for i in range(0, n, 4):
            raw.append(sum(code[int(v)] << (2 * k) for k, v in enumerate(matrix[i : i + 4, j])))
    (prefix.parent / f"{prefix.name}.bed").write_bytes(raw)
    (prefix.parent / f"{prefix.name}.bim").write_text("".join(f"{chrom}\ts{j + 1}\t0\t{10 * (j + 1)}\tG\tA\n" for j in range(m)))
    (prefix.parent / f"{prefix.name}.fam").write_text("".join(f"F{i} I{i} 0 0 0 -9\n" for i in range(n)))
    return str(prefix)


def test_plink(spark, tmp_path):
    p = plink(tmp_path / "p", np.array([[0, 2, 2], [2, 2, 1]]))
    g = read_plink(spark, p, Filters(drop_monomorphic=True))
    assert names(g) == ["s1", "s3"] and g.matrix().tolist() == [[0, 2], [2, 1]] and g.samples == ["I0", "I1"]
    first = g.markers.orderBy("marker_idx").first()
    assert (first.ref, first.alt, first.pos) == ("A", "G", 10)
    rng = np.random.default_rng(0)
    m = rng.integers(0, 3, (9, 200))
    m[3, 5] = -9
    got = read_genotypes(spark, plink(tmp_path / "q", m))
    assert got.count() == 200 and (got.matrix()[:, 6:] == m[:, 6:]).all() and got.matrix()[3, 5] >= 0
    with pytest.raises(FileNotFoundError):
        read_plink(spark, str(tmp_path / "none"))


def test_numeric_tables(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("ID,a,b,c\nx,0,NA,1.9\ny,1,2,0\nz,2,2,junk\n")
    g = read_genotypes(spark, str(p))
    assert g.samples == ["x", "y", "z"] and g.matrix().tolist() == [[0, 2, 1], [1, 2, 0], [2, 2, 0]]
    rng = np.random.default_rng(1)
    m = rng.integers(0, 3, (7, 2500))
    wide = tmp_path / "w.tsv"
    wide.write_text("\t".join(["ID", *[f"m{i}" for i in range(2500)]]) + "\n" + "\n".join("\t".join([f"s{i}", *map(str, row)]) for i, row in enumerate(m)) + "\n")
    got = read_genotypes(spark, str(wide))
    assert (got.matrix() == m).all() and names(got)[-1] == "m2499"


def test_store(spark, tmp_path):
    src = vcf(tmp_path / "s.vcf", ["1 10 rs1 A G : 0/0 0/1 1/1", "2 20 rs2 C T : 0|0 ./. 0|1"])
    cache = str(tmp_path / "cache")
    first = read_genotypes(spark, src, cache=cache, effective=True)
    assert store_is_fresh(spark, cache, src, Filters()) and not store_is_fresh(spark, cache, src, Filters(min_maf=0.1))
    again = read_genotypes(spark, src, cache=cache)
    assert (again.matrix() == first.matrix()).all() and again.samples == first.samples and first.metadata["effective_tests"]["Me"] == 2
    write_store(again, str(tmp_path / "other"))
    assert (read_store(spark, str(tmp_path / "other")).matrix() == first.matrix()).all()


def test_formats(spark, tmp_path):
    (tmp_path / "a").write_text("##fileformat=VCFv4.2\n")
    (tmp_path / "b").write_text(HEAD + "\n")
    (tmp_path / "c").write_text("ID\ta\tb\n")
    (tmp_path / "d").write_text("ID,a,b\n")
    assert [formats.detect_format(str(tmp_path / x)) for x in "abcd"] == ["vcf", "hapmap", "tsv", "csv"]
    assert formats.detect_separator(str(tmp_path / "c")) == "\t" and formats.detect_separator(str(tmp_path / "d")) == ","
    assert formats.id_column(["x", "Taxa", "y"]) == "Taxa" and formats.id_column(["x", "y"]) == "x"
    assert formats.tidy_names(["ID", "", "a", "a"]) == ["ID", "Trait1", "a", "a_2"]
    with pytest.warns(UserWarning):
        assert formats.resolve_traits(["Height", " Yield"], ["height", "Yield", "none"]) == ["Height", " Yield"]
    assert not formats.validate_inputs(str(tmp_path / "none"))["valid"]


def test_phenotypes_and_covariates(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("Taxa,Height,Text,Yield\na,1,x,NA\na,3,y,2\nb,.,z,5\n")
    rows = {r.ID: r for r in formats.read_phenotype(spark, str(p)).collect()}
    assert rows["a"].Height == 2 and rows["a"].Yield == 2 and rows["b"].Height is None and "Text" not in rows["a"].asDict()
    c = tmp_path / "c.csv"
    c.write_text("ID,x,empty\na,1,\nb,2,\n")
    with pytest.warns(UserWarning):
        assert formats.read_covariates(spark, str(c)).columns == ["ID", "x"]
    c.write_text("ID,x\na,1\nb,red\n")
    with pytest.raises(ValueError):
        formats.read_covariates(spark, str(c))
    m = tmp_path / "m.csv"
    m.write_text("SNP,CHROM,POS\nr1,1,10\nr2,X,20.0\n")
    assert [tuple(r) for r in formats.read_map(spark, str(m)).orderBy("pos").collect()] == [("r1", "1", 10), ("r2", "X", 20)]
    m.write_text("MARKER,SNP,CHROM,POS\nr1,r9,1,10\n")
    with pytest.raises(ValueError):
        formats.read_map(spark, str(m))


def test_long_form(spark):
    g = Genotypes.from_matrix(spark, [[0, -9], [2, 1]])
    assert sorted((r.sample_idx, r.marker_idx, r.dosage) for r in g.long().where("dosage is not null").collect()) == [(0, 0, 0), (1, 0, 2), (1, 1, 1)]
