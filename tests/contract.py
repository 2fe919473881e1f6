"""The feature contract by brute force: each row looks at every row before it."""

from gatewatch.schemas import FEATURE_COLUMNS

MARKERS = {"", "?", "-"}


def is_valid(*parts):
    return all(p is not None and p.strip() not in MARKERS for p in parts)


def expected_features(rows):
    """``rows``: dicts of parsed columns and ``seq``. Returns ``{seq: {feature: value}}``."""
    rows = sorted(rows, key=lambda r: (r["timestamp"], r["seq"]))
    out = {}
    for i, r in enumerate(rows):
        t, u, du, s, d = (r[c] for c in ("timestamp", "src_username", "username", "src_host", "destination_host"))
        before = rows[:i]
        recent = {w: [b for b in before if b["timestamp"] >= t - w] for w in (300, 3600)}

        def of_user(w):
            return [b for b in recent[w] if u is not None and b["src_username"] == u]

        def distinct(found, column):
            return len({b[column] for b in found if b[column] is not None})

        def pair_before(ka, a, kb, b_):
            return [b for b in before if b[ka] == a and b[kb] == b_]

        ud = pair_before("src_username", u, "destination_host", d)
        own = [b for b in before if b["src_username"] == u]
        values = [
            len(of_user(300)),
            sum(b["event_id"] == 4624 for b in of_user(300)),
            distinct(of_user(3600), "src_host"),
            distinct(of_user(300), "destination_host"),
            distinct(of_user(3600), "destination_host"),
            distinct([b for b in recent[3600] if s is not None and b["src_host"] == s], "username"),
            distinct([b for b in recent[3600] if d is not None and b["destination_host"] == d], "src_username"),
            sum(b["timestamp"] >= t - 3600 for b in ud) if is_valid(u, d) else 0,
            int(is_valid(u, s) and not pair_before("src_username", u, "src_host", s)),
            int(is_valid(u, d) and not ud),
            int(is_valid(s, d) and not pair_before("src_host", s, "destination_host", d)),
            t - own[-1]["timestamp"] if is_valid(u) and own else -1,
            t - ud[-1]["timestamp"] if is_valid(u, d) and ud else -1,
            int(r["event_id"] == 4624),
            t % 86400 // 3600,
            int(r["logon_type"] in ("Network", "3", "8")),
        ]
        out[r["seq"]] = dict(zip(FEATURE_COLUMNS, values))
    return out


PARSED_SCHEMA = ("timestamp bigint, src_username string, username string, src_host string, destination_host string, "
                 "logon_type string, event_id smallint, label tinyint, seq bigint")


def random_rows(rng, n, start=0, gaps=(0, 0, 0, 1, 30, 299, 300, 301, 1800, 3599, 3600, 3601)):
    names = lambda p, k: [f"{p}{i}" for i in range(k)] + [None, "?", "-", f" {p}0"]
    users, hosts, targets = names("u", 3), names("h", 3), names("d", 3)
    t, rows = start, []
    for i in range(n):
        t += rng.choice(gaps) if rng.random() < 0.6 else 0
        rows.append({"timestamp": t, "src_username": rng.choice(users), "username": rng.choice(users), "src_host": rng.choice(hosts),
                     "destination_host": rng.choice(targets), "logon_type": rng.choice(["3", "Network", "2", None]),
                     "event_id": rng.choice([4624, 4625, 0]), "label": rng.choice([0, 0, 1]), "seq": i})
    return rows


def frame(spark, rows):
    columns = [c.split()[0] for c in PARSED_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], PARSED_SCHEMA)


def by_seq(df):
    return {r["seq"]: {c: r[c] for c in FEATURE_COLUMNS} for r in df.collect()}
