"""rxspark: puzzle datasets of regular expressions, cleaned, compiled and scored as DataFrame transformations."""
