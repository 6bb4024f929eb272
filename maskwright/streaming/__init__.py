"""Documents that keep coming."""
