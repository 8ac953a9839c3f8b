"""Measures over usage tables.  ``w_`` keys read the warehouse side, ``l_`` keys the lakehouse side."""
