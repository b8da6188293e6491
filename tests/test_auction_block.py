"""A market of 1 GB of the check tool's tables (51,282 rows a side) is one block, so its price war doesn't go on a step a round."""

from evalmill.operators import auction


def test_one_block():
    assert -(-51_282 // auction.BLOCK) == 1
