"""Keeping factors current without a full fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from reelspark.functions.lineage import cut
from reelspark.operators.factors import average_factors, merge_factors
from reelspark.operators.foldin import fold_in_items, proposed_factors, solve_side
from reelspark.operators.ratings import (
    KEY,
    add_to_collection,
    remove_ratings,
    select_for_update,
    touched_rows,
    upsert_ratings,
)
from reelspark.plans.model import Model, Params
from reelspark.sources.ratings_store import RatingsStore


def _changed(ratings: DataFrame, batch: DataFrame, kind: str, params: Params) -> DataFrame:
    if kind == "rate":
        return upsert_ratings(ratings, batch)
    if kind == "own":
        return add_to_collection(ratings, batch, params.ownership)
    if kind == "remove":
        return remove_ratings(ratings, batch)
    raise ValueError(f"unknown kind of batch: {kind}")


@dataclass(frozen=True)
class Changes:
    """What a batch changes: factors (id, features) of the users and films solved
    again, the batch's ratings as they are afterwards, and the pairs removed."""

    user_factors: DataFrame
    item_factors: DataFrame
    ratings: DataFrame
    removed: DataFrame


def changes(model: Model, batch: DataFrame, kind: str = "rate", touched: DataFrame | None = None) -> Changes:
    """Change the ratings and re-solve the small profiles the batch touches.

    ``kind`` is ``rate`` (userId, movieId, rating), ``own`` or ``remove``
    (userId, movieId). Users are solved against the current films; films without
    factors get the mean of what their users propose; then films are solved
    against the updated users. A user left without ratings keeps the old
    factors. From the ratings table only the rows that share a user or film with
    the batch are taken, or ``touched`` if the caller has them; they and the
    factors solved from them are written to the shared folder.
    """
    p = model.params
    # Every row the batch changes shares a user with it, so the change can be
    # made on the touched rows alone.
    touched = cut(touched_rows(model.ratings, batch) if touched is None else touched)
    touched = cut(_changed(touched, batch, kind, p))
    user_rows, item_rows = map(cut, select_for_update(touched, batch, p.threshold))

    solved = cut(
        solve_side(user_rows, model.item_factors, "userId", "movieId", p.rank, p.iters, p.reg)
    )
    proposed = proposed_factors(
        user_rows, model.item_factors, solved, "userId", "movieId", p.rank, p.iters
    )
    new_items = cut(average_factors(proposed, p.rank))
    users = merge_factors(model.user_factors, solved)
    solved_items = cut(fold_in_items(item_rows, users, p.rank, p.iters, p.reg))

    pairs = batch.select(*KEY).distinct()
    kept = touched.join(pairs, KEY, "left_semi")
    removed = pairs if kind == "remove" else pairs.limit(0)
    return Changes(solved, cut(merge_factors(new_items, solved_items)), kept, removed)


def apply_changes(model: Model, made: Changes) -> Model:
    """The model with the changes in place of what they replace."""
    gone = made.ratings.select(*KEY).union(made.removed)
    ratings = model.ratings.join(gone, KEY, "left_anti").select(*model.ratings.columns)
    return model.with_(
        # The fit is as old as before, whatever became of the ratings it saw.
        known_users=model.train_users(),
        known_items=model.train_items(),
        ratings=ratings.unionByName(made.ratings.select(*model.ratings.columns)),
        user_factors=merge_factors(model.user_factors, made.user_factors),
        item_factors=merge_factors(model.item_factors, made.item_factors),
        updated_users=model.updated_users.union(made.user_factors.select("id")).distinct(),
        updated_items=model.updated_items.union(made.item_factors.select("id")).distinct(),
    )


def apply_batch(model: Model, batch: DataFrame, kind: str = "rate") -> Model:
    """The model after a batch, see ``changes``. Its tables are read from the old
    ones and from the changes, so ``save_model`` starts a long chain anew."""
    return apply_changes(model, changes(model, batch, kind))


def apply_to_store(
    model: Model, store: RatingsStore, batch: DataFrame, kind: str = "rate"
) -> tuple[Model, RatingsStore]:
    """The model and its ratings store after a batch, see ``changes``.

    Only the batch's buckets of the store are read, and a delta is added to it;
    the model's ratings are those of the store.
    """
    made = changes(model, batch, kind, store.touched(batch))
    after = store.apply(made.ratings, made.removed if kind == "remove" else None).compact()
    return apply_changes(model, made).with_(ratings=after.rows()), after
