import numpy as np
import pytest
from pyspark.sql import functions as F

from textrine.functions import numeric
from textrine.operators import windows
from textrine.sources import blocks, text


def test_window_options():
    s = blocks.WindowSpec
    assert s().resolved() == s(8_388_608, 1, 2, 1)
    assert s(8, 2, 3, "B").resolved().total == 4 and s(8, 2, 2, "F").resolved().total == 3
    assert s(8, 2, None, "F").resolved().total == 4 and s(8, 2, 9, "B").resolved().total == 9 and s(8, 2).resolved().window == 16
    with pytest.raises(NotImplementedError):
        s(method="L").resolved()
    with pytest.raises(ValueError):
        s(method="X").resolved()


def test_formatting(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.000 KiB", 1536: "1.500 KiB", 2047: "1.999 KiB", (1 << 20) - 1: "1023.999 KiB", (1 << 30) + (1 << 29): "1.500 GiB", (2 << 20) - 1: "2.000 MiB"}
    rows = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", numeric.human_size(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == sizes
    times = {0: "0 milliseconds (0 ms)", 1996: "1.100 seconds (1996 ms)", 61_005: "1 minutes, 1.01 seconds (61005 ms)", 3_600_000: "1 hours, 0 milliseconds (3600000 ms)"}
    rows = spark.createDataFrame([(k,) for k in times], "n long").select("n", numeric.human_time(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == times


def test_primes():
    sieve = [n for n in range(2, 5000) if all(n % d for d in range(2, int(n**0.5) + 1))]
    assert [n for n in range(5000) if numeric.witness(n) == 0] == sieve
    assert numeric.witness((1 << 61) - 1) == 0 and numeric.witness(3215031751) != 0 and numeric.following_prime(1) == 2 and numeric.following_prime(13) == 17
    assert numeric.fermat_witness(97) == 0 and numeric.fermat_witness(91) != 0


def test_hash_settings():
    tables = numeric.cuckoo_settings(100, 3)
    assert [t["size"] for t in tables] == [37, 41, 43] and [t["offset"] for t in tables] == [0, 37, 78]
    assert numeric.double_settings(100) == {"size": 101, "first": 101, "second": 99}


def test_transcoding(spark):
    df = spark.createDataFrame([(1, bytearray("žluťoučký".encode("cp1250")))], "doc_id long, content binary")
    assert text.transcode(df, "cp1250").first().text == "žluťoučký"
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xfe\xfa"))], "doc_id long, content binary")
    with pytest.raises(Exception):
        text.transcode(bad, "UTF-8").collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grüße".encode("utf-16-le"))
    assert text.read_texts(spark, str(tmp_path), "utf-16-le").first().text == "grüße"


def test_offsets(spark):
    rows = spark.createDataFrame([(2, 6, k) for k in range(8)], "begin long, end long, offset long")
    valid = [r.offset for r in windows.offset_valid(rows, 8, 2, batch_update=False).where("is_valid").orderBy("offset").collect()]
    assert valid == [2, 3, 4, 5]


def test_primes_of_whole_arrays():
    import numpy as np

    small = np.arange(-3, 5000)
    assert [int(n) for n in small[numeric.primes(small)]] == [n for n in range(2, 5000) if all(n % d for d in range(2, int(n**0.5) + 1))]
    strong = [2047, 3277, 1373653, 25326001, 3215031751, 2152302898747, 4294967291, 4294967295, 4294967296, 4294967311, 2**61 - 1, 2**62 + 1]
    assert numeric.primes(np.array(strong)).tolist() == [numeric.witness(n) == 0 for n in strong]
    at = np.array([0, 1, 2, 13, 4294967290, 4294967291, 2**40])
    assert numeric.following_primes(at).tolist() == [numeric.following_prime(int(n)) for n in at]


def test_random_numbers_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    rows = lambda n: {r.id: r.x for r in spark.range(0, 500, 1, n).select("id", numeric.random_below(F.col("id"), F.lit(10), 3).alias("x")).collect()}
    assert rows(1) == rows(7) and set(rows(1).values()) == set(range(10))


def carmichael(least: int) -> int:
    """The first (6k+1)(12k+1)(18k+1) of three primes above all bases that is ``least`` or more."""
    k = 7
    while True:
        factors = [6 * k + 1, 12 * k + 1, 18 * k + 1]
        n = factors[0] * factors[1] * factors[2]
        if n >= least and not any(numeric.witness(x) for x in factors):
            return n
        k += 1


def test_fermat_is_its_own_condition(spark):
    """Carmichael numbers without small factors pass and are not prime; all others are held against the powers themselves."""
    fooled = [carmichael(0), carmichael(10**7), carmichael(1 << 33)]
    numbers = [*range(-3, 3000), *fooled, (1 << 31) - 1, (1 << 32) - 5, (1 << 32) + 15, 56052361 + 2]
    passes = lambda n: n in (2, 3) or n > 3 and all(pow(a, n - 1, n) == 1 for a in numeric.WITNESSES if a % n)
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "n long")
    got = {r.n: (r.fermat, r.prime) for r in df.select("n", numeric.is_fermat_prime("n").alias("fermat"), numeric.is_prime("n").alias("prime")).collect()}
    assert {n: got[n][0] for n in numbers} == {n: passes(n) for n in numbers} and got[None] == (None, None)
    assert [got[n] for n in fooled] == [(True, False)] * 3


def test_primes_beyond_the_divisors_of_the_sql():
    """The SQL tries divisors to 199 and lists primes to 29,999; the functions have no such end (keys of ``part`` at 60 times sf0.1)."""
    n = 1_200_100
    sieve = np.ones(n, bool)
    sieve[:2] = False
    for p in range(2, 1096):
        if sieve[p]:
            sieve[p * p :: p] = False
    asked, known = np.arange(1_200_000), np.flatnonzero(sieve)
    assert (numeric.primes(asked) == sieve[:1_200_000]).all() and not sieve[[44521, 47053]].any()
    assert (numeric.following_primes(asked) == known[np.searchsorted(known, asked, "right")]).all()
    assert np.flatnonzero(numeric.fermat_primes(asked) != sieve[:1_200_000]).tolist() == [252601, 410041, 1152271]  # Carmichael numbers
