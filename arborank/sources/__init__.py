"""Tables in and out, and the logical views over them."""
