"""No streaming operators: the capability surface of this library is batch data-parallel programs."""
