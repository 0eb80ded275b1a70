"""Written tables and the scopes that delete them."""

import os

import pytest

from rowloom.session import discard, materialize, scratch


def there(df):
    return os.path.isdir(df._written_to.removeprefix("file:"))


def test_scope_deletes_all_but_what_is_kept(spark):
    free = materialize(spark.range(3))
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            lost, kept = materialize(spark.range(5)), materialize(spark.range(7))
            gone = materialize(spark.range(2))
            discard(gone)
            assert not there(gone) and there(lost)
            out = inner.keep(kept)
            lazy = inner.keep(kept.where("id > 2"))
        assert not there(lost) and out.count() == 7 and lazy.count() == 4
        outer.keep(lazy)
    assert not there(out) and lazy.count() == 4 and there(free)
    discard(free)
    assert not there(free)


def test_scope_ends_on_errors(spark):
    with pytest.raises(ValueError):
        with scratch(spark):
            lost = materialize(spark.range(5))
            raise ValueError
    assert not there(lost)
    assert there(materialize(spark.range(1)))
