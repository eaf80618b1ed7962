"""The column form of the address check says what the driver's form says."""

import pytest
from pyspark.sql import functions as F

from riskweave.functions import urls

HOSTS = """host.org HOST.org host.org:8443 host.org: 127.0.0.1 127.1 0x7f000001 0X7F.1 2130706433 017700000001 10.1 10.0.0.1 172.15.0.1 172.16.0.1 172.31.255.255 172.32.0.1
192.168.1.1 192.169.1.1 169.254.169.254 100.64.0.1 8.8.8.8 8.8.8.8:443 0x08.010.8.8 1.2.3.4.5 256.1.1.1 1.2.3 1.2.65536 0 0.0.0.0 224.0.0.1 239.255.255.255 240.0.0.1 255.255.255.255
192.0.0.1 192.0.0.9 192.0.0.10 192.0.0.170 192.0.2.1 198.18.0.1 198.51.100.7 203.0.113.9 203.0.114.9 localhost 08.1.1.1 1..2
[::1] [::] [::1]:8443 [::2] [::ffff:127.0.0.1] [::ffff:8.8.8.8] [::ffff:7f00:1] [::ffff:808:808] [::8.8.8.8] [::ffff:10.0.0.1]:443 [::ffff:256.1.1.1] [::ffff:01.1.1.1]
[2606:4700:4700::1111] [2606:4700:4700:0:0:0:0:1111] [2606:4700:4700:0000:0000:0000:0000:1111] [2001:4860:4860::8888] [2A00:1450:4001::200e] [2001:db8::1] [2001::1] [2001:1::1] [2001:1::3] [2001:3::7]
[2001:4:112::9] [2001:20::1] [2001:200::1] [2002:a00:1::] [64:ff9b::808:808] [64:ff9b:1::1] [100::1] [fc00::1] [fd12:3456::1] [fe80::1] [fe80::1%25eth0] [febf::1] [fec0::1] [ff02::1] [ffff::1] [3fff::1] [4000::1]
[1:2:3:4:5:6:7::] [1:2:3:4:5:6:7:8] [1:2:3:4:5:6:7] [1:2:3:4:5:6:7:8:9] [1::2::3] [:1] [1:] [:::] [12345::] [g::1] [] [::1 [2606:4700::1]x 2606:4700::1 [127.0.0.1] [host.org] [2606:4700:4700::1111]:""".split()
URLS = [
    "", " ", "https://", "https:///r", "http://host.org/r", "HTTPS://host.org/r", "hTtPs://HOST.org/r", "https://host.org/r\n", "\thttps://host.org/r", " https://host.org/r ", "https://host.org/a b", "https://u@host.org/r",
    "https://u:p@host.org/r", "https://host.org/@x", "https://host.org?x=/y", "https://host.org#f", "git@host.org:x/y", "ext::sh -c x", "file:///etc/passwd", "ssh://host.org/r", "https:host.org", "https:/host.org/r",
    "https://host.org/" + "a" * 2100, "https://host.org/\x00", "//host.org/r", "https://:443/r", " https://host.org/r", "https://[fe80::1%25eth0]@x/r",
]


def driver(url, allowed=None):
    try:
        urls.checked_git_url(url, allowed)
    except urls.UnsafeGitUrlError:
        return False
    return True


@pytest.mark.parametrize("allowed", [None, ["Host.org", "2606:4700:4700::1111"]])
def test_both_forms_agree(spark, allowed):
    given = URLS + [f"https://{h}/r" for h in HOSTS] + [f"HTTPS://{h}" for h in HOSTS]
    assert len(HOSTS) >= 100
    rows = spark.createDataFrame(list(enumerate(given)), "n long, url string")
    got = {r["n"]: r["ok"] for r in rows.select("n", urls.looks_clonable(F.col("url"), allowed).alias("ok")).collect()}
    wrong = [(u, got[n]) for n, u in enumerate(given) if got[n] != driver(u, set(allowed) if allowed else None)]
    assert not wrong
    assert 3 < sum(got.values()) < len(given) - 30
    assert spark.range(1).select(urls.looks_clonable(F.lit(None).cast("string")).alias("x")).first()["x"] is False
