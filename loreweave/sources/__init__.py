"""Tables, views and files that the operators read."""
