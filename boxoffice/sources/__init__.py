"""Tables, request intake and webhook intake."""
