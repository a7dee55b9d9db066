"""Tables, file inventories and boundary data."""
