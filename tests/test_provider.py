"""Provider sources: isolated failures, refused accounts, filters that save calls, a sync against plain dictionaries."""

import json

import pytest

from tonearm.sources import provider as P


def calls_client(folder):
    """A client of three accounts that leaves a file for each call; playlist 21 is unreachable."""

    class Client:
        def accounts(self):
            return [1, 2, 3]

        def playlists(self, account):
            (folder / f"list-{account}").touch()
            return [{"playlistId": f"{account}{k}", "title": f"t{k}", "mode": "off" if k == 0 else "full"} for k in range(3)] + [{"title": "no id"}]

        def tracks(self, account, item):
            (folder / f"tracks-{item['playlistId']}").touch()
            if item["playlistId"] == "21":
                raise TimeoutError("too slow")
            return json.dumps({"tracks": []})

    return Client


def called(folder):
    return sorted(p.name for p in folder.iterdir())


def test_a_failing_playlist_is_a_row(spark, tmp_path):
    df = P.read_provider(spark, "calls", calls_client(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    rows = {r.playlist_id: r for r in df.collect()}
    assert sorted(rows) == ["10", "11", "12", "20", "21", "22", "30", "31", "32"]
    assert rows["21"].error == "TimeoutError: too slow" and rows["21"].payload is None
    assert all(r.error is None and r.payload for k, r in rows.items() if k != "21")


@pytest.mark.parametrize(
    "only, listed, fetched",
    [
        ({"account_id": [2]}, ["2"], ["20", "21", "22"]),
        ({"account_id": [1, 3], "sync_mode": ["full"]}, ["1", "3"], ["11", "12", "31", "32"]),
        ({"playlist_id": ["31"]}, ["1", "2", "3"], ["31"]),
        ({"account_id": [9]}, [], []),
        ({"sync_mode": []}, ["1", "2", "3"], []),
        ({}, ["1", "2", "3"], [f"{a}{k}" for a in (1, 2, 3) for k in range(3)]),
    ],
)
def test_what_is_not_wanted_is_not_called(spark, tmp_path, only, listed, fetched):
    """The rows of a filter after a whole read, with no call for what it leaves out."""
    (tmp_path / "all").mkdir(), (tmp_path / "some").mkdir()
    every = P.read_provider(spark, "calls", calls_client(tmp_path / "all")).collect()
    got = P.read_provider(spark, "calls", calls_client(tmp_path / "some"), only=only).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in every if all(r[k] in v for k, v in only.items()))
    assert called(tmp_path / "some") == sorted([f"list-{a}" for a in listed] + [f"tracks-{k}" for k in fetched])


def test_scans_of_one_read_stay_apart(spark, tmp_path):
    df = P.read_provider(spark, "calls", calls_client(tmp_path))
    one, two = df.where("account_id = 1").select("playlist_id"), df.where("account_id = 2").select("playlist_id")
    assert sorted(r[0] for r in one.union(two).collect()) == ["10", "11", "12", "20", "21", "22"]
    assert one.count() == 3 and df.count() == 9 and one.join(df, "playlist_id").count() == 3


def test_unknown_wishes(spark):
    with pytest.raises(ValueError, match="title"):
        P.provider_source("x", dict, only={"title": ["t"]})


def test_listing_only(spark, tmp_path):
    rows = P.read_provider(spark, "calls", calls_client(tmp_path), tracks=False).collect()
    assert len(rows) == 9 and all(r.payload is None and r.error is None for r in rows)
    assert called(tmp_path) == ["list-1", "list-2", "list-3"]


ITEM = "account_id long, playlistId string, title string, mode string, status int, payload string"


def test_a_refused_account_ends_the_job(spark, tmp_path):
    P.land(spark.createDataFrame([(1, "a", "A", "full", 200, "{}"), (2, "b", "B", "full", 401, None)], ITEM), str(tmp_path / "x"))
    read = P.read_provider(spark, "refused", lambda: P.LandedClient(str(tmp_path / "x")))
    assert P.read_provider(spark, "refused", lambda: P.LandedClient(str(tmp_path / "x")), only={"account_id": [1]}).count() == 1
    with pytest.raises(Exception, match="account 2 was refused"):
        read.collect()


def test_sync_keeps_what_failed(spark, tmp_path):
    track = lambda i: {"videoId": i, "title": "T", "artists": [{"name": "X"}]}
    body = lambda *ids: json.dumps({"tracks": [track(i) for i in ids]})
    items = [
        (1, "good", "a\nb   c", "full", 200, body("g1", "g2")),
        (1, "empty", None, "full", 200, body()),
        (1, "broken", "t", "full", 200, '{"tracks": {"a": 1}}'),
        (1, "no json", "t", "full", 200, "<html>"),
        (1, "nothing", "t", "full", None, None),
        (2, "down", "t", "full", 500, None),
        (2, "twice", "t", "full", 500, None),
        (3, "twice", "t", "full", 200, body("w1")),
        (2, None, "t", "full", 200, body("lost")),
    ]
    path = str(tmp_path / "x")
    P.land(spark.createDataFrame(items, ITEM), path)
    stored = spark.createDataFrame([(k, 1, f"old {k}") for k in ("good", "empty", "broken", "no json", "nothing", "down", "twice", "unlisted")], "playlist_id string, position int, track_id string")
    fetched = P.read_provider(spark, "landed", lambda: P.LandedClient(path)).cache()
    assert {r.title for r in fetched.where("playlist_id = 'good'").collect()} == {"a\nb   c"}
    rows, states = P.synced(stored, fetched)
    assert sorted(map(tuple, rows.collect())) == sorted([("good", 1, "g1"), ("good", 2, "g2"), ("twice", 1, "w1")] + [(k, 1, f"old {k}") for k in ("broken", "no json", "nothing", "down", "unlisted")])
    assert {r.playlist_id: (r.account_id, r.n_tracks, r.error) for r in states.collect()} == {
        "good": (1, 2, None), "empty": (1, 0, None), "twice": (3, 1, None), "down": (2, None, "OSError: status 500"),
        "broken": (1, None, "malformed payload"), "no json": (1, None, "malformed payload"), "nothing": (1, None, "malformed payload"),
    }


def test_nothing_landed(spark, tmp_path):
    path = str(tmp_path / "none")
    assert P.read_provider(spark, "landed", lambda: P.LandedClient(path)).count() == 0
    P.land(spark.createDataFrame([], ITEM), path)
    assert P.read_provider(spark, "landed", lambda: P.LandedClient(path)).count() == 0
