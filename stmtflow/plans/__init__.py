"""Plan building blocks that keep every task bounded when one key holds a large share of the rows."""
